"""LM scoring: a bigram model by deleted interpolation.

    P(w | u) = a2[b] c(uw) / c(u) + a1[b] c(w) / N + a0[b] / (V + 1)

c are counts in the training documents, b is the bucket (a power of two) of the context's
frequency c(u), and the weights of each bucket are learned by expectation-maximisation on held-out
counts: every training document in turn is held out by deleting its own counts from all of c(uw),
c(u), c(w) and N. The EM sees those probabilities on a grid of GRID steps an octave (a bound on
what reaches the driver, not on the documents that count).

Counts are gathered over all documents: each token block sends its distinct words and word pairs
once, the owners of the hash ranges add them up and answer with the totals. Items are told apart
by the leading bits of a 64-bit hash, 24 bits more than it takes to number all tokens, so the
chance that an item shares its key with another is below 2^-24.

Null and empty texts are the end token alone; a null id is held out or not as empty text would be;
rows that repeat an id count as often as they occur. With no training tokens V is 0 and all
weight goes to the uniform part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, ASK, Block, answer, bundle, by_owner, join_blocks, map_blocks, owners_for, to_blocks, unbundle
from .common import materialize, mix, pack, pack_sorted, ranked, release, unpack, unpack_sorted

END, BEGIN = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0xB5297A4D3F84D5B5)
GRID = 4
BUCKETS = 64
ITERATIONS = 60
FLOOR = 1e-7  # least weight of the uniform part, so that every text has a probability


class _Tokens:
    """Words and end tokens of a block, its distinct words (kind 1) and word pairs (kind 2)."""

    def __init__(self, block: Block, bits: int):
        words, counts = block.hashes(), block.counts
        self.counts = counts + 1
        n = int(self.counts.sum())
        ends = np.cumsum(self.counts) - 1
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        self.token = np.full(n, END)
        self.token[~is_end] = words
        self.context = np.empty(n, np.uint64)
        self.context[1:] = self.token[:-1]
        self.context[np.concatenate([[0], ends[:-1] + 1])] = BEGIN
        with np.errstate(over="ignore"):
            self.pair = mix(mix(self.context) * np.uint64(3) + self.token)
        self.document = np.repeat(np.arange(len(counts)), self.counts)
        self.trains = np.asarray(block.flags, np.int64)[self.document] == 1
        self.drop = np.uint64(64 - bits)

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes in place and ascending distinct keys; kind 1 always has the end token."""
        return ranked((self.token if kind == 1 else self.pair) >> self.drop)


def _ask(owners: int, bits: int):
    def ask(block: Block) -> Iterator[dict]:
        t = _Tokens(block, bits)
        for kind in (1, 2):
            codes, keys = t.distinct(kind)
            counts = np.bincount(codes[t.trains], minlength=len(keys))
            for owner, part in by_owner(keys << t.drop, owners):
                yield {"owner": owner, "block": block.block, "kind": kind, "data": bundle(pack_sorted(keys[part]), pack(counts[part]))}

    return ask


def _total(owner: int, rows: list[dict]) -> Iterator[dict]:
    for kind in (1, 2):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        data = [unbundle(r["data"]) for r in own]
        keys = np.concatenate([unpack_sorted(k) for k, _ in data])
        codes, distinct = pd.factorize(keys)
        sums = np.bincount(codes, np.concatenate([unpack(c) for _, c in data]).astype(float), len(distinct)).astype(np.int64)
        at = 0
        for r, (_, c) in zip(own, data, strict=True):
            n = len(unpack(c))
            yield {"block": r["block"], "kind": kind, "owner": owner, "data": pack(sums[codes[at : at + n]]), "tokens": 0, "types": 0}
            at += n
        if kind == 1:
            yield {"block": None, "kind": 0, "owner": owner, "data": None, "tokens": int(sums.sum()), "types": int((sums > 0).sum())}


class _Counted:
    """A block's tokens with the totals of their words, contexts and pairs."""

    def __init__(self, block: Block, got: dict, owners: int, bits: int, deleted: bool):
        t = self.tokens = _Tokens(block, bits)

        def totals(kind: int) -> tuple[np.ndarray, np.ndarray]:
            codes, keys = t.distinct(kind)
            each = np.concatenate([unpack(got[kind, owner]) for owner, _ in by_owner(keys << t.drop, owners)]).astype(np.int64)
            return codes, each

        word_code, each = totals(1)
        self.word = each[word_code]
        pair_code, pairs = totals(2)
        self.pair = pairs[pair_code]
        begins = t.context == BEGIN
        previous = np.concatenate([[0], np.arange(len(word_code) - 1)])
        ends = np.cumsum(t.counts) - 1
        of_end = int(self.word[ends[0]]) if len(ends) else 0
        self.context = np.where(begins, of_end, self.word[previous])
        if deleted:
            own = lambda codes: _per_document(codes, t.document)
            mine = own(word_code)
            self.pair = self.pair - own(pair_code)
            self.word = self.word - mine
            self.context = self.context - np.where(begins, 1, mine[previous])
            self.document_tokens = t.counts[t.document]


def _per_document(codes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """How often each token's item occurs in its own document."""
    both, _ = pd.factorize(document * (int(codes.max()) + 1 if len(codes) else 1) + codes)
    return np.bincount(both)[both]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), 0)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _grid(owners: int, bits: int, n: int, v: int):
    def step(p: np.ndarray) -> np.ndarray:
        """Quarter octaves above the uniform part; -1000 stands for 0."""
        return np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300) * (v + 1))), -1000).astype(np.int64)

    def rows(block: Block, got: dict) -> Iterator[dict]:
        c = _Counted(block, got, owners, bits, True)
        use = c.tokens.trains
        p2, p1 = _ratio(c.pair, c.context), _ratio(c.word, n - c.document_tokens)
        codes, keys = pd.factorize((_bucket(c.context)[use] * 4096 + step(p2)[use] + 1024) * 4096 + step(p1)[use] + 1024)
        for key, count in zip(keys.tolist(), np.bincount(codes, minlength=len(keys)).tolist(), strict=True):
            yield {"cell": key, "n": count}

    return rows


def learn_weights(cells: np.ndarray, counts: np.ndarray, v: int) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform parts by EM over the grid."""
    bucket, q2, q1 = cells >> 24, ((cells >> 12) & 4095) - 1024, (cells & 4095) - 1024
    p = np.stack([np.where(q > -1000, 2.0 ** (q / GRID), 0.0) for q in (q2, q1)] + [np.ones(len(cells))], 1) if len(cells) else np.empty((0, 3))
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen = np.bincount(bucket, counts, BUCKETS) if len(cells) else np.zeros(BUCKETS)
    for _ in range(ITERATIONS if len(cells) else 0):
        share = weights[bucket] * p
        share *= (counts / share.sum(1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(3)], 1)
        weights = np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None], weights)
    for b in range(BUCKETS):  # a bucket nobody has seen held out takes its neighbour's weights
        if not seen[b]:
            lower = weights[b - 1] if b > 1 else np.array([0.0, 0.5 if len(cells) else 0.0, 0.5 if len(cells) else 1.0])
            weights[b] = lower
    weights[0, 0] = 0.0
    weights[:, 2] = np.maximum(weights[:, 2], FLOOR)
    return weights / weights.sum(1, keepdims=True)


def _score(owners: int, bits: int, n: int, v: int, weights: np.ndarray, key: str):
    def rows(block: Block, got: dict) -> Iterator[dict]:
        c = _Counted(block, got, owners, bits, False)
        w = weights[_bucket(c.context)]
        p = w[:, 0] * _ratio(c.pair, c.context) + w[:, 1] * (c.word / max(n, 1)) + w[:, 2] / (v + 1)
        base = np.log10((c.word + 0.5) / (n + 0.5 * (v + 1)))
        document, docs = c.tokens.document, len(block.ids)
        score, base, known = (np.bincount(document, x, docs) for x in (np.log10(p), base, c.word > 0))
        for i, f, t, k, b, s in zip(block.ids, block.flags, c.tokens.counts, known, base, score, strict=True):
            yield {key: i, "held_out": f != 1, "n_tokens": int(t), "n_known": int(k), "train_tokens": n, "base_score": float(b), "score": float(s)}

    return rows


def lm_scores(df: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability); trains: boolean, learn from this row."""
    blocks = materialize(to_blocks(df, key, text, flag=trains, lower=True, block_bytes=block_bytes))
    owners = owners_for(blocks)
    tokens = blocks.agg(F.sum(F.col("words") + F.size("ids"))).first()[0] or 1
    bits = min(64, 24 + int(tokens).bit_length())
    asked = map_blocks(blocks, _ask(owners, bits), ASK)
    answers = materialize(answer(asked, _total, ANSWER + ", tokens long, types long"))
    release(df.sparkSession)
    n, v = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    replies = answers.where("block is not null").select("block", "kind", "owner", "data")
    grid = join_blocks(blocks, replies, _grid(owners, bits, n, v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(float), v)
    schema = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    release(df.sparkSession)
    return join_blocks(blocks, replies, _score(owners, bits, n, v, weights, key), schema)
