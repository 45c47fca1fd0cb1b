import base64
import glob
import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import documents
from pyspark.sql import functions as F

from marlstone.llm import components, decontamination, jaccard_join, line_dedup, packing, quality_rules, substring_dedup, token_counts, toxicity, warc
from marlstone.llm.common import tokenizer_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", items string, n_words int")


# ----------------------------------------------------------------- 1
def contaminated(rows, items, k=10):
    bench = {}
    for i, t in items:
        w = ITEM.findall((t or "").translate(LOW))
        for a in range(max(1, len(w) - k + 1) if w else 0):
            bench.setdefault(tuple(w[a : a + k]), set()).add(i)
    lengths = {len(x) for x in bench}
    out = []
    for i, t in rows:
        w, hit, found = ITEM.findall((t or "").translate(LOW)), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in bench:
                    hit |= set(range(a, a + n))
                    found |= {str(y) for y in bench[x] if y is not None}
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    rows = documents(3)
    rng = random.Random(3)
    items = [(None, "never seen before by any of these documents at all, truly")]
    for i in range(30):
        w = SPACE.findall(rng.choice(rows)[1] or "x")
        at, n = rng.randrange(len(w)), rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 25])
        items.append((i, "-".join(w[at : at + n]).upper()))
    items += [(50, None), (51, ""), (52, "?!"), (53, items[5][1]), (7, items[6][1])]
    got = decontamination.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()) == contaminated(rows, items)


def test_decontamination_of_nothing(spark):
    empty, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(empty, items).count() == 0
    got = decontamination.decontaminate(spark.createDataFrame([(1, "a b")], SCHEMA), items).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


# ----------------------------------------------------------------- 2
def naive_pack(rows, capacity):
    rest, out = [], []
    for i, n, s, c in rows:
        out += [(i, p, capacity) for p in range((n or 0) // capacity)]
        if (n or 0) % capacity:
            rest.append((-(n % capacity), i, n // capacity, s, c))
    bins = []
    for minus, i, piece, s, c in sorted(rest, key=lambda x: x[:2]):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= -minus and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "s": set(), "c": set(), "in": []})
        bins[k]["left"] += minus
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        bins[k]["in"].append((i, piece))
    return {k: b["in"] for k, b in enumerate(bins)}, Counter(out)


def test_packing_equals_naive_best_fit(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 1, 7, 64, 100, 128, rng.randrange(1, 300)]), rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.choice([None, 1, 1, 2, 3, *range(10, 200)])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, n int, source string, cluster int")
    got = [r for r in packing.best_fit(df, F.col("n"), F.col("source"), F.col("cluster"), capacity=128).collect()]
    bins, full = naive_pack(rows, 128)
    have = {}
    for r in sorted((r for r in got if r.bin is not None and r.n_tokens < 128), key=lambda r: r.start):
        have.setdefault(r.bin, []).append((r.doc_id, r.piece))
    assert have == bins
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got if r.n_tokens == 128) == full
    assert {r.doc_id for r in got if r.bin is None} == {i for i, n, *_ in rows if not n}


def test_packing_in_shards_keeps_every_token_and_no_conflict(spark):
    rng = random.Random(6)
    rows = [(i if i % 50 else None, rng.randrange(0, 400), rng.choice(["hot", "a", "b"]), i % 7) for i in range(500)] * 2
    df = spark.createDataFrame(rows, "doc_id long, n int, source string, cluster int")
    got = packing.best_fit(df, F.col("n"), F.col("source"), F.lit(None).cast("int"), capacity=128, shard_rows=100).collect()
    assert sum(r.n_tokens for r in got) == sum(r[1] for r in rows)
    assert len({r.shard for r in got}) > 3
    fill = Counter()
    for r in got:
        fill[r.shard, r.bin] += r.n_tokens * (r.bin is not None)
    assert max(fill.values()) <= 128
    pieces = {}
    for r in got:
        if r.bin is not None and r.n_tokens < 128:
            pieces.setdefault((r.shard, r.bin), []).append((r.start, r.n_tokens))
    for own in pieces.values():  # pieces of a bin follow each other, and of one source there is one
        ends = 0
        for start, n in sorted(own):
            assert start == ends
            ends += n
        assert len(own) <= 3
    one = packing.best_fit(df, F.col("n"), F.col("source"), F.lit(None).cast("int"), capacity=128, shard_rows=10**6).collect()
    assert sum(r.bin is not None and r.n_tokens == 128 for r in got) == sum(r.bin is not None and r.n_tokens == 128 for r in one)
    assert packing.best_fit(df.limit(0), F.col("n"), F.col("source"), F.col("cluster")).count() == 0


# ----------------------------------------------------------------- 3
def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    calm = ["river", "stone", "cloud", "meadow", "paper", "window", "garden", "simple", "quiet", "letter"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(calm) + str(i % 3) * 0 for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["you idiot", "1d10t", "STUPID!!", "s t u p i d", "worthless", "zorgblatt"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if i % 4 == 2]
    right = sum(got[i].predicted == int(i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "idiot " * 5000), (2, "a\x00b")], SCHEMA)
    assert toxicity.score(odd, model).count() == 4


def test_toxicity_learns_words_of_texts_that_share_frequent_words(spark):
    """The texts of a language have its frequent words in common; they are no copies of each other."""
    rng = random.Random(11)
    frequent, rows, labels = [f"{a}{b}" for a in "klmn" for b in "aeio"], [], []
    for i in range(800):
        w = rng.choices(frequent, k=120)
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["schurke", "trottel", "gauner"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    texts = [t for _, t in rows]
    assert len({toxicity.signature(t) for t in texts}) > 0.9 * len(texts)
    assert len({toxicity.signature(t) for t in (texts[0], texts[0].upper(), texts[0].replace(" ", ", "))}) == 1
    assert toxicity.signature(None) == toxicity.signature("12 !") and toxicity.signature("one") != toxicity.signature("two")
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab.where("doc_id % 4 <> 2"))
    assert all(model.lexicon.weight(w) > toxicity.STRONG for w in ("schurke", "trottel", "gauner"))
    assert {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()} == {i for i, y in labels if y}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()] == [1.0, 1.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, one)).count() == 0


def test_calibrated_scores_grow_with_raw_scores():
    rng = np.random.default_rng(3)
    raw = np.sort(rng.normal(size=500) * 4)
    y = (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float)
    model = toxicity.Model(toxicity.Lexicon({}), toxicity.Trees(0.0, *[np.zeros((0, 1))] * 3), *toxicity.isotonic(raw, y))
    got = model.calibrated(np.r_[-1e9, raw, 1e9])
    assert (np.diff(got[1:-1]) > 0).all() and 0 <= got.min() and got.max() <= 1
    assert np.abs(got[1:-1] - np.interp(raw, model.knots, model.levels)).max() <= toxicity.TIES
    assert len(set(got)) > 20 * len(set(model.levels)) / 2


def test_isotonic_levels_ascend():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float)
    knots, levels = toxicity.isotonic(raw, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and 0 <= levels[0] and levels[-1] <= 1


def reference_boost(x, y, trees):
    """Every cut of every feature tried by brute force; the raw score of each row."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    raw = np.full(len(y), np.log(rate / (1 - rate)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        leaves = [np.arange(len(y))]
        for _ in range(toxicity.DEPTH):
            out = []
            for rows in leaves:
                best, cut = 1e-9, None
                for j in range(x.shape[1]):
                    for c in np.unique(x[rows, j])[:-1]:
                        left = x[rows, j] <= c
                        if min(left.sum(), (~left).sum()) < toxicity.LEAF:
                            continue
                        part = lambda m: g[rows[m]].sum() ** 2 / (h[rows[m]].sum() + toxicity.RIDGE)
                        gain = part(left) + part(~left) - g[rows].sum() ** 2 / (h[rows].sum() + toxicity.RIDGE)
                        if gain > best + 1e-12:
                            best, cut = gain, left
                out += [rows] if cut is None else [rows[cut], rows[~cut]]
            leaves = out
        for rows in leaves:
            raw[rows] += toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.RIDGE)
    return raw


def test_boosting_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 7, 120), rng.integers(0, 5, 120), rng.integers(0, 2, 120)], 1).astype(float)
    y = (rng.random(120) < 1 / (1 + np.exp(3 - x[:, 0] + x[:, 1] * x[:, 2]))).astype(float)
    monkeypatch.setattr(toxicity, "TREES", 6)
    monkeypatch.setattr(toxicity, "BINS", 400)
    assert np.allclose(toxicity.boost(x, y).raw(x), reference_boost(x, y, 6))


def test_isotonic_equals_the_best_monotone_fit(monkeypatch):
    """The level of a point is the largest over starts of the least mean to an end (the min-max formula)."""
    rng = np.random.default_rng(4)
    raw = np.sort(rng.permutation(40)).astype(float)
    y = (rng.random(40) < raw / 40).astype(float)
    knots, levels = toxicity.isotonic(raw, y)
    want = [max(min(y[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]
    got = np.interp(raw, knots, levels)
    size = {r: sum(w == v for w in want) for r, v in zip(raw, want, strict=True)}
    smoothed = [(v * size[r] + 0.01) / (size[r] + 0.1) for r, v in zip(raw, want, strict=True)]
    assert np.allclose(got, np.maximum.accumulate(smoothed))


def test_a_lexicon_never_counts_its_own_fold():
    counts = toxicity.Counts(["bad$", "other$"], np.array([[9, 0, 0, 0], [3, 3, 3, 3]]), np.array([[9, 0, 0, 0], [3, 3, 3, 3]]), np.array([[9, 0, 0, 0], [3, 3, 3, 3]]), np.zeros((2, 4), int), np.full((2, 4), 1000), np.full((2, 4), 10))
    assert set(counts.weights(None)) == {"bad$", "other$"} and set(counts.weights(0)) == {"other$"}


# ----------------------------------------------------------------- 4
def test_sketches_add_up_and_never_underestimate():
    rng = np.random.default_rng(5)
    parts = []
    for _ in range(4):
        cells = np.unique(rng.integers(1000, 1300, 80)).astype(np.uint64)
        parts.append((cells, rng.integers(0, 2, len(cells)).astype(np.uint8)))
    low, total = substring_dedup.merged(parts)
    want = Counter()
    for cells, twice in parts:
        for c, t in zip(cells.tolist(), twice.tolist(), strict=True):
            want[c] += 1 + t
    assert {low + k: n for k, n in enumerate(total.tolist()) if n} == want


@pytest.mark.parametrize("bits", [4, 6, 16])
def test_a_narrow_sketch_changes_no_result(spark, monkeypatch, bits):
    from test_llm_blocks import kept

    monkeypatch.setattr(substring_dedup, "width_bits", lambda words: bits)
    rows = documents(7)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA), block_bytes=2000).withColumn("s", F.sha2("kept", 256)).select("doc_id", "n_words", "n_removed", "s")
    assert Counter(map(tuple, got.collect())) == kept(rows)


# ----------------------------------------------------------------- 5
def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    odd = ["<|startoftext|> x<|endoftext|>y", "don't we'll I'M 'S", "a b ć é", "İstanbul ΣΑΣ ß ﬁ", "日本語 テスト 🎉🎉🎉", "\x00\x01\x1f", "a\u0085b c", "1234567 12,5%", "<|endoftext|", "x" * 3000]
    rows = documents(4) + [(500 + i, t) for i, t in enumerate(odd)]
    store = token_counts.prefix_counts(frame(spark, rows))
    got = token_counts.fit_budget(store, 50).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    length = {(r.doc_id, r.n_bytes): len(r.prefix_growth) for r in store.collect()}
    for r in got:
        assert r.n_tokens_kept <= 50 and (r.truncate_at == length[r.doc_id, r.n_bytes]) == (r.n_tokens <= 50)
    assert token_counts.fit_budget(token_counts.prefix_counts(frame(spark, [])), 5).count() == 0


ODD = ["  We'll see: Tokenization of\tprefixes, isn't it? naïve 12 <|endoftext|> end\n", "don't we'LL I'M 'S 'rest !'s ''ve 'l", "a b ć é", "İstanbul ΣΑΣ ß ﬁ", "日本語テスト 🎉🎉🎉", "\x00\x01\x1f", "a\u0085b\u3000c", "1234567 12,5%", "<|endoftext|", "x" * 300, "e\u0301a\u0300 x\u0338≠", "\u1100\u1161\u11a8각", "ǅ Ǆ ẞ", "\u212a \u212b Å", "aaaa aaaaaaa lll lllll ....... !!!!!!", "", None]


def test_every_prefix_of_every_text(spark):
    """The store is built, the tokenizer is gone, and each prefix has the library's count."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if len(t or "") < 1500]
    counter = token_counts.PieceCounter(path)
    stores = counter.stores([t or "" for t in texts])
    del counter
    for t, store in zip(texts, stores, strict=True):
        want = [len(e) for e in library.encode_batch_fast([(t or "")[:i] for i in range(len(t or "") + 1)], add_special_tokens=False)]
        got = token_counts.running(store).tolist()
        assert got == want
        for budget in (0, 3, 40):
            rows = [i for i, n in enumerate(want) if n <= budget]
            n = token_counts.running(store)
            assert rows[-1] == token_counts.longest_within(n, budget)


PARTS = ["\u00e9", "e\u0301", "\u0301", "\u0323", "\u0344", "a", "the", "'", "'s", "'re", "'r", "'ll", "l", "v", "S", "!", "..", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>", "\u0130", "\u00df", "\u4e2d", "\u3000", "\u00a0", "\u00bd", "\u0663", "\u1100\u1161", "\u1161", "n\u0303", "\u03a3", "\U0001f389", "\U0001f469\u200d", "\ufb01", "\u212b", "7", "\u0915\u094d\u0937"]


def test_odd_pieces_by_clusters_equal_the_library():
    """What the normaliser changes, cut short anywhere, with special tokens whole and in part."""
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(5)
    library, counter = Tokenizer.from_file(path), token_counts.PieceCounter(path)
    for _ in range(5000):
        s = "".join(rng.choices(PARTS, k=rng.randrange(1, 9)))
        assert counter.prefixes(s) == [len(e) for e in library.encode_batch_fast([s[: i + 1] for i in range(len(s))], add_special_tokens=False)], repr(s)


@pytest.mark.parametrize("text", ["\u4e2d\u6587\u5b57" * 33_333 + "e\u0301", "\u4e2d\u6587\u5b57" * 33_333 + "<|endoftext|>", "e\u0301" * 50_000, "\u1100\u1161\uac01" * 30_000, "!" * 50_000 + "\u0130"])
def test_long_pieces_take_linear_time(text):
    import time

    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.PieceCounter(path)
    took = []
    for part in (text[: len(text) // 4], text):
        start = time.process_time()
        store = counter.stores([part])[0]
        took.append(time.process_time() - start)
    assert took[1] < 12 * max(took[0], 0.5)  # quadratic: 16 times as long, and minutes
    at = [*range(0, len(text), len(text) // 100), len(text)]
    counts = token_counts.running(store)
    assert [int(counts[i]) for i in at] == [len(e) for e in library.encode_batch_fast([text[:i] for i in at], add_special_tokens=False)]
    assert not any(len(p) > token_counts.LONG for p in counter.known)


def test_a_growth_beyond_a_byte_is_an_error(monkeypatch):
    counter = token_counts.PieceCounter(tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(counter, "_program", lambda piece: [200] * len(piece))
    with pytest.raises(OverflowError):
        counter.growth("ab")


def test_other_tokenizer_forms_are_refused():
    with pytest.raises(ValueError):
        token_counts.PieceCounter(tokenizer_path("byte_bpe_50k.json"))


# ----------------------------------------------------------------- 7
def lines_left(rows, least):
    seqs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [p for p, x in enumerate(lines) if SPACE.search(x)]
        seqs.append((float("inf") if i is None else i, lines, at))
    first = {}
    for i, lines, at in seqs:
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                run = tuple(lines[p] for p in at[a:b])
                first[run] = min(first.get(run, (i, a)), (i, a))
    out = []
    for (i, t), (n, lines, at) in zip(rows, seqs, strict=True):
        gone = set()
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                run = tuple(lines[p] for p in at[a:b])
                if sum(len(SPACE.findall(x)) for x in run) >= least and first[run] < (n, a):
                    gone |= set(at[a:b])
        out.append((i, len(at), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 1, 2, 3, 12]))) for _ in range(9)] + ["", " \t"]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))))
    rows += [(100 + i, rows[rng.randrange(40)][1]) for i in range(8)] + [(200, None), (201, ""), (202, "\n\n"), (None, rows[3][1]), (203, "a\n" * 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_removed int").select("text", "doc_id", "n_removed")
    got = line_dedup.line_dedup(df, min_words=6).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in got) == lines_left(rows, 6)


def maximal_runs(rows):
    """(id, pos, len, where it is found earlier) by comparing every place with every earlier one; ids and texts differ."""
    lines = {i: [x for x in (t or "").split("\n") if SPACE.search(x)] for i, t in rows}
    places = [(i, p) for i in sorted(lines) for p in range(len(lines[i]))]
    longest = {}
    for k, (i, p) in enumerate(places):
        for j, q in places[:k]:
            n = 0
            while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n] == lines[j][q + n]:
                n += 1
            if n > longest.get((i, p), (0,))[0]:
                longest[i, p] = (n, j, q)
    return Counter((i, p, *longest[i, p]) for i, p in longest if longest.get((i, p - 1), (0,))[0] <= longest[i, p][0])


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_maximal_runs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[f"{rng.choice('abc')} {rng.randrange(4)}" for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    rows = []
    for i in range(25):
        parts = [x for _ in range(rng.randrange(4)) for x in (rng.choice(pool), [f"own {i} {rng.randrange(9)}"] * rng.randrange(3))]
        rows.append((i, "\n".join([x for p in parts for x in p] + [f"end {i}"])))
    rows.append((30, "same\n" * 40))
    got = Counter()
    for r in line_dedup.repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect():
        got += Counter((r.i, x.pos, x.len, x.source_id, x.source_pos) for x in r.runs)
    want = maximal_runs(rows)
    assert Counter((i, p, n) for i, p, n, *_ in got) == Counter((i, p, n) for i, p, n, *_ in want)
    lines = {i: [x for x in t.split("\n") if SPACE.search(x)] for i, t in rows}
    for i, p, n, j, q in got:  # an earlier place that reads the same
        assert (j, q) < (i, p) and lines[i][p : p + n] == lines[j][q : q + n]


def test_line_dedup_of_nothing_and_of_repeated_rows(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "one two three four five six seven eight nine ten")] * 2 + [(6, "one two three four five six seven eight nine ten")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == {(5, 0): 2, (6, 1): 1}


# ----------------------------------------------------------------- 8
def test_quality_measures_equal_plain_counts(spark):
    rows = documents(8) + [(600, "a b c a b c x"), (601, "# $ % & | < > * é\n#\n#\n # \n"), (602, "x y\nx y\n\n\nx y\nz"), (603, "the of and " * 30)]
    got = quality_rules.quality_rules(spark.createDataFrame([(*r, True, 1.0) for r in rows], SCHEMA + ", kept boolean, n_words double")).collect()
    want = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        c = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
        rep = {p for a in range(len(w) - 2) if c[tuple(w[a : a + 3])] > 1 for p in range(a, a + 3)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), base))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.quality_rules(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ----------------------------------------------------------------- 9
def test_warc_round_trip(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h/{i}?a=b\r\nX: y" if i % 5 else None, rng.choice([None, "", "<p>é</p>", "x" * 100_000, "\r\n\r\n", f"page {i}", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"])) for i in range(80)]
    rows.append((None, "u", "only a null id"))
    got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        to = last[t or ""]
        own = i is None or to == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else to))
    assert Counter(map(tuple, got)) == Counter(want)
    small = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=50).collect()
    assert {r.record_type for r in small if r.payload_bytes < 50} == {"response"}
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_archives_are_a_member_a_record(spark, tmp_path):
    rows = [(i, "http://h/", f"page {i} " * i) for i in range(20)]
    marked = warc.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "page_id", "html")
    paths = warc.write_archives(marked, f"file://{tmp_path}")
    archives = warc.normalise(paths, f"file://{tmp_path}")
    whole, members = glob.glob(f"{tmp_path}/whole/*.gz"), glob.glob(f"{tmp_path}/members/*.gz")
    assert b"".join(gzip.open(p).read() for p in whole) == b"".join(gzip.open(p).read() for p in members)
    index = [(a.archive, r) for a in archives.collect() for r in warc.read_sidecar(a.sidecar)]
    for archive, r in index:
        with open(archive.removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            member = f.read(r["length"])
        assert zlib.decompress(member, 31).startswith(b"WARC/1.1\r\n")
    assert len(index) == 20 and sum(os.path.getsize(p) for p in members) == sum(r["length"] for _, r in index)
    assert warc.read_records(archives).count() == 20
    # the sidecar is what is read: another order gives another order, a wrong line an error
    side = archives.first().sidecar.removeprefix("file://")
    lines = open(side).readlines()
    open(side, "w").writelines(reversed(lines))
    assert [r.page_id for r in warc.read_records(archives).collect()] == [int(x.split("urn:x-page:")[1].split(">")[0]) for x in reversed(lines)]
    open(side, "w").writelines([lines[0].replace("x-page:", "x-page:9"), *lines[1:]])
    with pytest.raises(Exception, match="not the one of the index"):
        warc.read_records(archives).collect()


def test_warc_of_odd_pages(spark):
    """Very long and repeated pages, nulls in every column, columns with clashing names."""
    big = "<p>" + "x" * 3_000_000
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (None, None, None), (None, None, None), (3, None, ""), (4, "é ü\r\nX: y", "b\r\n\r\nc"), (4, "u", "other")]
    df = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "page_id long, url string, html string, payload_digest string, refers_to string, stays int")
    got = warc.warc_round_trip(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter([(1, len(big), "revisit", 2), (2, len(big), "response", None), (2, len(big), "response", None), (None, 0, "revisit", 3), (None, 0, "revisit", 3), (3, 0, "response", None), (4, 6, "response", None), (4, 5, "response", None)])


# ----------------------------------------------------------------- 10
def linked(rows):
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(LOW))
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([30, 60, 200]))] for _ in range(5)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        if rng.random() < 0.3:
            w = w[: int(len(w) * rng.uniform(0.7, 1))]
        out.append((i * 7 % 1009, " ".join(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1, 2000, 4 << 20])
def test_jaccard_components_equal_brute_force(spark, block_bytes):
    rows = documents(10) + near_copies(10, 150)
    got = jaccard_join.jaccard_components(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", set string, n int"), block_bytes=block_bytes)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)


@pytest.mark.parametrize("deepest,carry", [(1, 32), (8, 32), (8, 0), (8, 3)])
@pytest.mark.parametrize("seed", [11, 12])
def test_jaccard_at_any_depth_is_the_same(spark, monkeypatch, deepest, carry, seed):
    monkeypatch.setattr(jaccard_join, "DEEPEST", deepest)
    monkeypatch.setattr(jaccard_join, "CARRY", carry)
    rows = near_copies(seed, 120)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)


def passages(n, seed=3):
    """Texts of 8 of 24 shared passages: all share some, hardly any link."""
    rng = random.Random(seed)
    own = [[f"p{k}w{j}" for j in range(50)] for k in range(24)]
    return [(i, " ".join(w for k in rng.sample(range(24), 8) for w in own[k])) for i in range(n)]


def test_jaccard_of_shared_passages_equals_brute_force(spark):
    rows = passages(120) + [(1000, passages(1)[0][1] + " tail")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked(rows)


def test_jaccard_rows_grow_with_the_length_of_texts(spark, monkeypatch):
    """Three unlinked texts that share halves: what is written for candidates is linear in their length."""
    sizes = []
    for n in (1000, 4000):
        half = [[f"h{k}_{j}" for j in range(n // 2)] for k in range(3)]
        rows = [(k, " ".join(half[k] + half[(k + 1) % 3])) for k in range(3)]
        size, plain = [], jaccard_join.materialize
        monkeypatch.setattr(jaccard_join, "materialize", lambda df, plain=plain, size=size: (out := plain(df), size.append(sum(len(str(r)) for r in out.collect())))[0])
        assert len({r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}) == 3
        monkeypatch.setattr(jaccard_join, "materialize", plain)
        sizes.append(sum(size))
    assert sizes[1] < 5 * sizes[0]


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    got = jaccard_join.jaccard_components(spark.createDataFrame([(2, None), (3, "")], SCHEMA)).collect()
    assert {tuple(r) for r in got} == {(2, 0, 2), (3, 0, 3)}


def test_components_of_long_paths(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "a")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(1, 41)} | {"y": "x"}


# ----------------------------------------------------------------- pipeline
def test_pipeline_stages_equal_their_rules(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{i % 3 if i else 0}", len(t)) for i, t in near_copies(12, 60) + [(2000 + k, " ".join(f"w{k}_{j}" for j in range(60))) for k in range(20)]]
    rows.append((3000, "you idiot you stupid worthless moron " * 4, "en", "s1", 10))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, " ".join(f"w3_{j}" for j in range(20, 35)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows[:-1]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [(i, t) for i, t, *_ in rows]
    deduped = [(i, t) for (i, n, gone, t), c in lines_left(texts, line_dedup.MIN_WORDS).items() for _ in range(c) if not n or gone < n]
    groups = linked(deduped)
    stays = {i for (i, _, root), c in groups.items() if i == root}
    clean = {i for (i, *_, bad), c in contaminated([r for r in deduped if r[0] in stays], [(5, " ".join(f"w3_{j}" for j in range(20, 35)))]).items() if not bad}
    assert 2003 not in clean and {2000 + k for k in range(20) if k != 3} <= clean
    assert {r.doc_id for r in got} == clean
    words = {i: len(SPACE.findall(t)) for i, t in deduped}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == {i: words[i] for i in clean}
