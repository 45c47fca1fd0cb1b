"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates of a text alone: words of a lexicon learned from the labels, also behind obfuscation
(digits and signs for letters, spaced-out letters), second-person words and their nearness to lexicon words,
capitals, punctuation and obfuscated spellings. No list of insults is given: the lexicon is what the labels
show.

The classifier is fitted on at most SAMPLE_ROWS labelled rows, those whose ids hash lowest (of rows that
repeat an id, one); every text is scored whole. The lexicon has whole words (marked by a closing $) and stems, the
first STEM letters of words. An entry begins words of SUPPORT toxic rows, and of the share SHARE of them, that are not copies
of each other (the effective number of their min-hash signatures), and at least the share PRECISION of its occurrences
stand in toxic rows; its weight is the logarithm of how much more often it occurs there than in clean rows, and a word has the weight of its longest
entry. Rows are dealt into FOLDS by signature, so that copies stay together, and the features of a row come from
a lexicon learned without its fold: the trees see features as good as those of new texts. Raw scores for
the calibration likewise come from trees that have not seen the row's fold. A score is for the share TIES the raw probability
and the rest the calibrated one, so it grows with the raw score inside a level too.

Null and empty texts have all rates 0 and get the score of such a row; rows without a label are
not learned from, several labels of one id count as the largest; without two classes the score
is the share of toxic rows, 0 without any. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, release, window_hash

SAMPLE_ROWS = 40_000
SUPPORT, SHARE, PRECISION = 3, 0.012, 0.8
STEM = range(4, 11)
STRONG = 3.0  # weight from which an entry marks a word as bad: eight times as frequent in toxic rows
THRESHOLD = 0.3
TIES = 0.02  # weight of the raw probability beside the calibrated level, which is the same for a whole block of raw scores
NEAR = 3  # words on either side that count as near
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 80, 3, 0.15, 48, 8, 1.0
FOLDS = 4
RUN = 5  # words of the runs whose least hash tells copies, as in the Jaccard join

#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
#: Signs that stand for letters.
DISGUISE = str.maketrans("013457@$!|+", "oieastasilt")

SIGNS = np.frombuffer(b"0123456789@$!*|+", np.uint8)

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W_]*[^\W\d_][\d@$!*|+]+[^\W\d_][\w@$!*|+]*|[@$!013457][^\W\d_]{3,}[\w@$!*|+]*")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)")
FEATURES = ["log_words", "lexicon", "log_lexicon", "bad", "log_bad", "masked_lexicon", "second_person", "near_second_person", "capitals", "capital_words", "exclamations", "punctuation", "digits", "masked", "spaced"]


def _entries(word: str) -> Iterator[str]:
    """The lexicon entries that may stand for a word, the longest first."""
    if len(word) >= 3:
        yield word + "$"
    for k in reversed(STEM):
        if k <= len(word):
            yield word[:k]


class Lexicon:
    """Entries with weights; whole words among the strong ones answer for asterisks."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = frozenset(w[:3] for w in weights)
        self.whole = [w[:-1] for w, v in weights.items() if w[-1] == "$" and v > STRONG]

    def weight(self, word: str) -> float:
        if word[:3] not in self.heads:
            return 0.0
        return next((self.weights[x] for x in _entries(word) if x in self.weights), 0.0)

    def hidden(self, token: str) -> bool:
        """token, with signs for letters, reads as a bad word."""
        plain = token.lower().translate(DISGUISE)
        if "*" in plain:
            shape = re.compile(re.escape(plain).replace("\\*", "."))
            return len(plain.replace("*", "")) >= 2 and any(len(w) == len(plain) and shape.fullmatch(w) for w in self.whole)
        return self.weight(plain) > STRONG or self.weight(plain.replace("i", "l")) > STRONG


def features(texts: list[str | None], lexicons: list[Lexicon]) -> np.ndarray:
    """One row a text; lexicons: the one for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for r, (text, lexicon) in enumerate(zip(texts, lexicons, strict=True)):
        if not text:
            continue
        words = WORD.findall(text.lower())
        n = max(1, len(words))
        heads = lexicon.heads
        weights = [(i, lexicon.weight(w)) for i, w in enumerate(words) if w[:3] in heads]
        total = sum(v for _, v in weights)
        bad = np.array([i for i, v in weights if v > STRONG])
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if len(second) and len(bad):
            at = np.searchsorted(bad, second)
            gaps = [min(abs(bad[max(a - 1, 0)] - s), abs(bad[min(a, len(bad) - 1)] - s)) for a, s in zip(at, second, strict=True)]
            near = sum(g <= NEAR for g in gaps)
        byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        masked = MASKED.findall(text) if byte[SIGNS].any() else []
        single = [i for i, w in enumerate(words) if len(w) == 1]
        spaced = SPACED.findall(text) if any(b - a == 3 for a, b in zip(single, single[3:])) else []
        hidden = sum(map(lexicon.hidden, masked)) + sum(lexicon.weight(re.sub(r"[ .\-_]", "", s.lower())) > STRONG for s in spaced)
        size = max(1, len(text))
        capitals = byte[65:91].sum()
        signs = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
        shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if capitals > 2 else 0
        out[r] = [np.log1p(len(words)), total / n, np.log1p(total), len(bad) / n, np.log1p(len(bad)), np.log1p(hidden), len(second) / n, np.log1p(near), capitals / size, shouted / n, byte[33] / size, signs / size, byte[48:58].sum() / size, len(masked) / n, len(spaced) / n]
    return out


# ----------------------------------------------------------------- trees
@dataclass
class Trees:
    """Complete binary trees: node j of a tree goes to 2j+1 if the feature is at most the cut, else to 2j+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(x.shape[1])]
    for j in range(x.shape[1]):  # a rare feature's quantiles are all zero: bin what is above
        if (above := x[x[:, j] > 0, j]).size:
            cuts[j] = np.unique(np.concatenate([cuts[j], [0.0], np.quantile(above, np.linspace(0, 1, 8))[:-1]]))
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    inner = 2**DEPTH - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    raw = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            own = at - first
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = own * width + binned[:, j]
                sums = [np.cumsum(np.bincount(key, w, nodes * width).reshape(nodes, width), 1) for w in (g, h, np.ones(len(y)))]
                gl, hl, nl = (s[:, : len(c)] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                for k in np.flatnonzero(value > best):
                    best[k], feature[t, first + k], cut[t, first + k] = value[k], j, c[top[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        own = at - inner
        leaf[t] = RATE * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + RIDGE)
        raw += leaf[t, own]
    return Trees(base, feature, cut, leaf)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending knots and their levels."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, size, first, last
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.array([v for b in blocks for v in [(b[0] + 0.01) / (b[1] + 0.1)] * 2])
    return knots, np.maximum.accumulate(levels)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    levels: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.levels[0])
        return self.calibrated(self.trees.raw(features(texts, [self.lexicon] * len(texts))))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Isotonic levels, with a small part of the raw probability, so that texts of one level are still told apart."""
        level = np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)
        return level + TIES * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - level)


def fit_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: Lexicon) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, np.zeros(1), np.array([float(y.mean()) if len(y) else 0.0]))
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and 0 < y[~own].sum() < (~own).sum():
            raw[own] = boost(x[~own], y[~own]).raw(x[own])
    return Model(lexicon, boost(x, y), *isotonic(raw, y))


# ----------------------------------------------------------------- learning
def _texts(batch: pa.RecordBatch, i: int) -> list[str | None]:
    return [None if t.as_py() is None else t.as_py().decode("utf-8", "replace") for t in batch[i].cast(pa.binary())]


def signature(text: str | None) -> int:
    """The least hash of the runs of RUN words: copies and most near copies have the same. Single words would not do: the texts of a
    language share its frequent words, so that texts with nothing else in common would have the same."""
    words = WORD.findall((text or "").lower())
    if not words:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(RUN, len(words))
    return int(window_hash(hashes, np.arange(len(words) - k + 1), k).min())


@dataclass
class Counts:
    """What the lexicon is chosen from, by fold: of each entry its occurrences in toxic rows, the toxic rows that have it, the
    sum of squares of rows that have one signature, and its occurrences in clean rows; characters and rows of both classes."""

    entry: list[str]
    n: np.ndarray
    rows: np.ndarray
    squares: np.ndarray
    clean: np.ndarray
    size: np.ndarray
    docs: np.ndarray

    def weights(self, without: int | None) -> dict[str, float]:
        """The lexicon without a fold."""
        use = np.array([f != without for f in range(FOLDS)])
        n, d, d2, c = (x[:, use].sum(1).astype(float) for x in (self.n, self.rows, self.squares, self.clean))
        good, bad = self.size[0, use].sum(), self.size[1, use].sum()
        least = max(SUPPORT, SHARE * self.docs[1, use].sum())
        odds = (n + 0.5) / (c + 0.5) * (good / max(bad, 1))
        keep = (d * d >= least * d2) & (d >= least) & (n >= PRECISION * (n + c)) & (odds > 1 if good else True)
        return {self.entry[k]: float(np.log2(odds[k])) if good else 10.0 for k in np.flatnonzero(keep)}


def _count_entries(sample: DataFrame) -> Counts:
    """sample: t, y. Entries are those of SUPPORT and SHARE of the bounded sample's toxic rows."""
    import pandas as pd

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 0)
            yield pa.RecordBatch.from_pydict({"y": batch[1], "fold": pa.array([signature(t) % FOLDS for t in texts], pa.int32()), "n": pa.array([len(t or "") for t in texts], pa.int64())})

    size, docs = np.zeros((2, FOLDS), np.int64), np.zeros((2, FOLDS), np.int64)
    for r in sample.select("t", "y").mapInArrow(sizes, "y int, fold int, n long").where("y in (0, 1)").groupBy("y", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect():
        size[r.y, r.fold], docs[r.y, r.fold] = r.n, r.docs
    least = max(SUPPORT, SHARE * (docs[1].sum() - docs[1].max()))  # the least that any lexicon asks for

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _texts(batch, 0):
                if own := Counter(x for w in WORD.findall((t or "").lower()) for x in _entries(w)):
                    s = np.full(len(own), signature(t), np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"entry": list(own), "signature": pa.array(s), "n": list(own.values())})

    seen = sample.where("y = 1").select("t").mapInArrow(of_toxic, "entry string, signature long, n long").groupBy("entry", "signature").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    fold = F.conv(F.hex("signature"), 16, 10).cast("decimal(20,0)") % FOLDS  # of the unsigned number
    sums = [F.sum(F.when(fold == f, v).otherwise(0)).alias(f"{name}{f}") for name, v in (("n", F.col("n")), ("rows", F.col("rows")), ("squares", F.col("rows") * F.col("rows"))) for f in range(FOLDS)]
    toxic = seen.groupBy("entry").agg(*sums, F.sum("rows").alias("d")).where(F.col("d") >= float(least)).toPandas()
    place = {x: k for k, x in enumerate(toxic["entry"])}
    clean = np.zeros((len(place), FOLDS), np.int64)

    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros((len(place), FOLDS), np.int64)
            for t in _texts(batch, 0):
                at = [place[x] for w in WORD.findall((t or "").lower()) for x in _entries(w) if x in place]
                np.add.at(own, (at, signature(t) % FOLDS), 1)
            k, f = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(f, pa.int64()), pa.array(own[k, f])], ["k", "fold", "n"])

    if place:
        got: pd.DataFrame = sample.where("y = 0").select("t").mapInArrow(of_clean, "k long, fold long, n long").groupBy("k", "fold").agg(F.sum("n").alias("n")).toPandas()
        clean[got["k"].to_numpy(), got["fold"].to_numpy()] = got["n"].to_numpy()
    table = lambda name: toxic[[f"{name}{f}" for f in range(FOLDS)]].to_numpy(np.int64)
    return Counts(toxic["entry"].to_list(), table("n"), table("rows"), table("squares"), clean, size, docs)


def choose_rows(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """k, y of at most rows labelled ids, those that hash lowest; what meets in one task is little more than rows."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    n = known.count()
    if n > 2 * rows:  # a hash below this is expected of 1.2 * rows ids
        known = known.where(F.shiftrightunsigned(F.xxhash64("k"), 11) < int(2**53 * 1.2 * rows / n))
    return known.orderBy(F.shiftrightunsigned(F.xxhash64("k"), 11), "k").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most rows labelled documents."""
    chosen = choose_rows(labels, key, label, rows)
    # the sample is bounded by rows, so it may be broadcast; of documents that repeat an id one is taken
    joined = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k")
    sample = materialize(joined.groupBy("k", F.col("y").cast("int").alias("y")).agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", "y"))
    counts = _count_entries(sample)
    lexicon = Lexicon(counts.weights(None))
    without = [Lexicon(counts.weights(f)) for f in range(FOLDS)]
    del counts

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = _texts(part, 0)
                folds = [signature(t) % FOLDS for t in texts]
                x = features(texts, [without[f] for f in folds])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part[1], pa.array(folds, pa.int32())], ["x", "y", "fold"])

    got = sample.mapInArrow(extract, "x array<double>, y int, fold int").toPandas()
    release(docs.sparkSession, sample)
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, got["fold"].to_numpy(), got["y"].to_numpy())) if len(got) else np.empty(0, np.int64)
    return fit_rows(x[order], got["y"].to_numpy(float)[order], got["fold"].to_numpy()[order], lexicon)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = model.score(_texts(part, 1))
                yield pa.RecordBatch.from_arrays([part[0], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["k", "score", "predicted"])
            give_back()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "k long, score double, predicted int").withColumnRenamed("k", key)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, all columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array(model.score(_texts(part, at)) < threshold))
            give_back()

    return docs.mapInArrow(run, docs.schema)
