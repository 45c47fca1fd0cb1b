import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from corpus import documents
from pyspark.sql import functions as F

from marlstone.llm import common, lm_scoring, substring_dedup
from marlstone.llm.common import crc_fold

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def kept(rows, k=13):
    texts = [(float("inf") if i is None else i, SPACE.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, texts, strict=True):
        goes = {p for a in range(len(w) - k + 1) if least[tuple(w[a : a + k])] < n for p in range(a, a + k)}
        left = " ".join(x for p, x in enumerate(w) if p not in goes)
        out.append((i, len(w), len(goes), hashlib.sha256(left.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1, 3000, 6 << 20])
def test_substring_dedup_equals_brute_force(spark, block_bytes):
    rows = documents(1)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", kept string, block int")
    got = substring_dedup.substring_dedup(df, block_bytes=block_bytes).withColumn("s", F.sha2("kept", 256)).select("doc_id", "n_words", "n_removed", "s")
    assert Counter(map(tuple, got.collect())) == kept(rows)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, None)], SCHEMA)).collect()] == [(1, 0, 0, "")]


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*SPACE.findall(low), "</s>"]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


@pytest.mark.parametrize("block_bytes", [1, 3000, 6 << 20])
def test_lm_counts_equal_brute_force(spark, block_bytes):
    rows = documents(2)
    train = [tokens(t) for i, t in rows if crc(i) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pair = Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    context = Counter(a for t in train for a in ["<s>", *t[:-1]])
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, SCHEMA), crc_fold(F.col("doc_id"), 5) != 1, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        own = tokens(t)
        want.append((str(i), crc(i) % 5 == 1, len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    # the same weights over plain counts give the same scores
    by = {(str(r.doc_id), r.n_tokens): r.score for r in got}
    w = weights_of(rows)
    for i, t in rows[:20]:
        own, s = tokens(t), 0.0
        for a, b in zip(["<s>", *own], own):
            k = 0 if not context[a] else 1 + int(math.log2(context[a]))
            s += math.log10(w[k][0] * (pair[a, b] / context[a] if context[a] else 0) + w[k][1] * c[b] / n + w[k][2] / (v + 1))
        assert abs(by[str(i), len(own)] - s) < 0.02 * abs(s) + 1e-6


def weights_of(rows):
    """Held-out weights from plain counts, without the grid."""
    train = [tokens(t) for i, t in rows if crc(i) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pair = Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    context = Counter(a for t in train for a in ["<s>", *t[:-1]])
    seen = {}
    for t in train:
        cw, cp, cc = Counter(t), Counter(zip(["<s>", *t], t)), Counter(["<s>", *t[:-1]])
        for a, b in zip(["<s>", *t], t):
            x = context[a] - cc[a]
            k = 0 if x <= 0 else 1 + int(math.log2(x))
            seen.setdefault(k, []).append(((pair[a, b] - cp[a, b]) / x if x > 0 else 0, (c[b] - cw[b]) / (n - len(t)), 1 / (v + 1)))
    out = {}
    for k in range(64):
        w = [1 / 3] * 3
        for _ in range(60 if k in seen else 0):
            sums = [0.0] * 3
            for p in seen[k]:
                z = sum(x * y for x, y in zip(w, p))
                for j in range(3):
                    sums[j] += w[j] * p[j] / z
            w = [x / len(seen[k]) for x in sums]
        if k not in seen:
            w = out[k - 1] if k > 1 else [0, 0.5, 0.5]
        w = [0 if k == 0 else w[0], w[1], max(w[2], 1e-7)]
        out[k] = [x / sum(w) for x in w]
    return out


def test_lm_scores_held_out_text_better_than_the_base(spark):
    rows = [(i, " ".join(["red fox", "blue whale", "grey owl"][(i + j) % 3] for j in range(40))) for i in range(40)]
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, SCHEMA), crc_fold(F.col("doc_id"), 5) != 1).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.score > r.base_score for r in held)


def test_lm_without_training_rows(spark):
    got = lm_scoring.lm_scores(spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert lm_scoring.lm_scores(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_packed_integers_and_codes_round_trip():
    import numpy as np

    from marlstone.llm import common

    rng = np.random.default_rng(7)
    for values in ([], [0], [255, 256, 0], rng.integers(0, 1 << 63, 1000), rng.integers(0, 5, 1000, np.int32)):
        values = np.array(values, None if len(values) else np.uint64)
        assert np.array_equal(common.unpack(common.pack(values)), values.astype(np.uint64))
        place, distinct = common.ranked(values)
        assert np.array_equal(distinct, np.unique(values)) and np.array_equal(distinct[place], values)


def test_window_hash_is_the_same_for_all_positions_and_for_few():
    import numpy as np

    from marlstone.llm.common import window_hash

    hashes = np.random.default_rng(7).integers(0, 1 << 63, 50).astype(np.uint64)
    every = window_hash(hashes, np.arange(46), 5)
    assert np.array_equal(window_hash(hashes, np.array([3, 40]), 5), every[[3, 40]])
    assert len(window_hash(hashes[:3], np.empty(0, np.int64), 5)) == 0


def test_blocks_split_at_ascii_white_space_only():
    import pyarrow as pa

    from marlstone.llm.blocks import Block, _encode

    texts = ["", " ", "a b", "\tb\x0b c\x0c\r\n", "\xa0d\u2003e \x1c", "é a"]
    block = Block(_encode(0, list(range(6)), [0] * 6, pa.array(texts, pa.large_string())))
    words = [block.vocabulary[c].decode() for c in block.codes]
    assert block.counts.tolist() == [0, 0, 2, 2, 2, 2] and words == ["a", "b", "b", "c", "\xa0d\u2003e", "\x1c", "é", "a"]


def test_words_are_counted_as_they_are_split(spark):
    texts = ["", " ", "a", " a", "a ", " a  b\n", "\x0b\x0c a\tb c", None, "a\u00a0b", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(common.count_words(F.col("t"), common.SPACES).alias("n"), F.size(common.split_words(F.col("t"), common.SPACES)).alias("m"))
    assert all(r.n == r.m for r in df.collect())


def test_words_are_counted_in_bytes_as_they_are_split(spark):
    """Over more texts than one slice; a word ends with its text, null and empty texts have none."""
    from marlstone.llm import packing

    texts = ["", " ", "a", " a", "a ", " a  b\n", "\x0b\x0c a\tb c", None, "a\u00a0b", "\n\n", "x\x1cy \x00 z", "é\u2003ü é", "a b c d e f"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {r.doc_id: r.n for r in df.select("doc_id", F.size(common.split_words(F.col("text"), common.SPACES)).alias("n")).collect()}
    counted = common.words_for_text(df, "text", "n")
    assert counted.columns == ["doc_id", "n"] and {r.doc_id: r.n for r in counted.collect()} == want
    assert common.words_for_text(df.limit(0), "text", "n").count() == 0
    near = packing.near_duplicates(df, words="n")
    assert near.columns == ["doc_id", "n", "cluster"] and {r.doc_id: r.n for r in near.collect()} == want
    assert {(r.doc_id, r.cluster) for r in near.collect()} == {(r.doc_id, r.cluster) for r in packing.near_duplicates(df).collect()}


def test_no_scratch_is_left_when_the_driver_ends(tmp_path):
    """Archives of op9 and scratch tables, in a driver of its own."""
    import os
    import subprocess
    import sys
    import time

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
from marlstone.llm import warc
pages = spark.createDataFrame([(1, "u", "body"), (2, "v", "body"), (3, None, None)], "page_id long, url string, html string")
rows = warc.warc_round_trip(pages).collect()
import os
print(len(rows), sum(f.endswith(".warc.gz") for _, _, fs in os.walk("{tmp_path}") for f in fs))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    n, archives = map(int, done.stdout.split())
    assert n == 3 and archives >= 2
    for _ in range(60):  # the JVM ends a little later than Python
        if not (left := [f for _, _, files in os.walk(tmp_path) for f in files]):
            break
        time.sleep(1)
    assert left == []
