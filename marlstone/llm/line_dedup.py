"""Line dedup: of line runs that repeat across the corpus, later copies are deleted.

The corpus is the sequence of the lines with a word of all documents, in order of id; runs stay
inside a document. A line is deleted if it lies in a run of lines with MIN_WORDS words or more
together that also starts at an earlier place; runs are judged on the input.

Suffix array by prefix doubling. Lines get numbers, and every suffix gets its rank among the runs of 1, 2, 4,
... lines it starts with, its place in order of (rank of the first half, rank of the second half) over range
partitions of the distinct pairs. Suffixes alone with their rank are settled and leave; the doubling ends when none is
left, after the logarithm of the longest repeated run. Suffixes of equal rank are an interval of the suffix array whose
common prefix is that long at least.

Longest-common-prefix intervals. An interval with exactly length l in common is found by halving: in each interval of length 2^j
only the earliest suffix of each inner interval of length 2^(j+1) takes part (its leader; what two inner intervals
have in common, their leaders have), and the members are parted by the ranks of the 2^(j-1), 2^(j-2), ... lines that
follow. Members that agree go on together with the longer prefix, and one leader of them with the shorter. What ends up together
differs right after l lines and is one interval, its members the leaders of the intervals inside it. The
earliest member stays; for each other the run of l lines is the longest that starts at an earlier place, named by
that member. Every step is a count and a least place by key, combined before the shuffle, so a line or a run that a
third of all rows hold costs one row a task, and what is joined back to suffixes is a table of its own, so that AQE
can split a hot key.

Copies of a whole document are one document at first: the first stands for all.

Null and empty texts have no lines; lines without a word are kept and end no run; null ids come
last; rows that repeat id and text are alike. All columns of the input are kept, but columns named
like the two results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, drop, give_back, materialize, partitions, release

#: Words a repeated run must have to be deleted: one, so that every line with a word that occurred earlier goes.
MIN_WORDS = 1


def _numbered(df: DataFrame, order: list[str], step: str | None, name: str) -> DataFrame:
    """df with a number in order: how many rows (or how much of step) come before, counted in each range partition from
    its own start. step: a column of long."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    arrow = to_arrow_schema(schema)
    by = df.columns.index(step) if step else None

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = np.ones(batch.num_rows, np.int64) if by is None else batch[by].to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at + np.cumsum(n) - n, pa.int64())], schema=arrow)
            at += int(n.sum())

    return df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(number, schema)


def _place() -> Column:
    return F.struct("d", "pos")


def _rank(suffixes: DataFrame) -> DataFrame:
    """d, pos, h1, h2 of suffixes to d, pos, rank of those that share their pair, and whether they are the first to have it."""
    counted = suffixes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("least")).where("n > 1")
    ranked = _numbered(counted, ["h1", "h2"], "n", "rank").select("h1", "h2", "rank", "least")
    return materialize(suffixes.join(ranked, ["h1", "h2"]).select("d", "pos", "rank", (_place() == F.col("least")).alias("leader")))


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """lines: d, pos, h1, h2. For runs of 1, 2, 4, ... lines: d, pos, rank, leader of the suffixes that share theirs."""
    levels, size = [], 1
    while not (ranks := _rank(lines)).isEmpty():
        levels.append(ranks)
        second = ranks.select("d", (F.col("pos") - size).cast("int").alias("pos"), F.col("rank").alias("h2"))
        pairs = materialize(ranks.select("d", "pos", F.col("rank").alias("h1")).join(second, ["d", "pos"]))
        if size > 1:
            drop(lines.sparkSession, lines)
        lines, size = pairs, 2 * size
    release(lines.sparkSession, ranks, *([lines] if size > 1 else []))
    return levels


def lcp_intervals(levels: list[DataFrame]) -> DataFrame:
    """d, pos, len, source of every suffix that begins like an earlier one: the most lines in common with
    an earlier place, and that place. levels: of suffix_ranks, at least one."""
    spark = levels[0].sparkSession
    every = reduce(DataFrame.union, [x.select("d", "pos", F.lit(j).alias("j"), F.lit(1 << j).alias("a"), "rank", "leader") for j, x in enumerate(levels)])
    inner = every.select("d", "pos", (F.col("j") - 1).alias("j"), F.col("leader").alias("leads"))
    # a (the length so far) and g name the interval a row is in
    rows = materialize(every.join(inner, ["d", "pos", "j"], "left").where("leads is null or leads").select("d", "pos", "a", F.xxhash64("j", "rank").alias("g")))
    for j in range(len(levels) - 2, -1, -1):
        step = 1 << j
        long, short = rows.where(F.col("a") >= 2 * step), rows.where(F.col("a") < 2 * step)
        ahead = levels[j].select("d", F.col("pos").alias("_at"), "rank")
        # those whose next lines are like nobody's are a class of their own, below 0
        known = long.withColumn("_at", F.col("pos") + F.col("a")).join(ahead, ["d", "_at"], "left")
        classed = materialize(known.select("d", "pos", "a", "g", F.coalesce("rank", F.xxhash64("d", "pos").bitwiseOR(F.lit(-(1 << 63)))).alias("c")))
        classes = classed.groupBy("a", "g", "c").agg(F.count("*").alias("n"), F.min(_place()).alias("least"))
        several = classes.groupBy("a", "g").agg(F.count("*").alias("k"))
        placed = classed.join(classes.join(several, ["a", "g"]).where("n > 1 or k > 1"), ["a", "g", "c"])
        longer = F.when(F.col("n") > 1, F.struct((F.col("a") + step).alias("a"), F.xxhash64("g", "c", F.lit(j)).alias("g")))
        shorter = F.when((F.col("k") > 1) & (_place() == F.col("least")), F.struct("a", "g"))
        both = placed.select("d", "pos", F.explode(F.array_compact(F.array(longer, shorter))).alias("x")).select("d", "pos", "x.a", "x.g")
        new = materialize(short.union(both))
        drop(spark, rows, classed)
        rows = new
    found = materialize(rows.groupBy("a", "g").agg(F.count("*").alias("n"), F.min(_place()).alias("source")).where("n > 1"))
    return rows.join(found, ["a", "g"]).where(_place() > F.col("source")).select("d", "pos", F.col("a").alias("len"), "source")


DOCS = "i long, t long, u long, words long, h1 array<bigint>, h2 array<bigint>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return _signed(x >> 64), _signed(x & (2**64 - 1))


def _lines(text: bytes) -> list[bytes]:
    """The lines with a word."""
    return [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], DOCS).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()), strict=True):
                data = t.as_py() or b""
                lines = _lines(data)
                a, b = zip(*map(_halves, lines), strict=True) if lines else ((), ())
                high, low = _halves(data)
                rows.append({"i": NULL_ID if i is None else i, "t": high, "u": low, "words": sum(len(x.split()) for x in lines), "h1": a, "h2": b})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)
            give_back()

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(read, DOCS)


RUNS = "array<struct<pos:int,len:int,source_id:bigint,source_pos:int>>"


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """i, t, u (id, or NULL_ID, and text hash of a document) and runs: the maximal runs that also start at an earlier place, by
    place: pos and len among the lines with a word, and where it is found earlier (source_id, source_pos)."""
    spark = df.sparkSession
    docs = materialize(_documents(df, key, text))
    whole = F.struct("i", "t", "u")
    firsts = materialize(docs.groupBy("t", "u").agg(F.min(whole).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = docs.join(firsts, ["t", "u"], "left").withColumn("copy", F.coalesce(whole > F.col("first"), F.lit(False)))
    run = F.struct(F.lit(0).alias("pos"), F.size("h1").alias("len"), F.col("first.i").alias("source_id"), F.lit(0).alias("source_pos"))
    copies = marked.where("copy and size(h1) > 0").select("i", "t", "u", F.array(run).cast(RUNS).alias("runs")).dropDuplicates(["i", "t", "u"])
    own = marked.where("not copy and size(h1) > 0").select("i", "t", "u", "h1", "h2").dropDuplicates(["i", "t", "u"])
    ones = materialize(_numbered(own, ["i", "t", "u"], None, "d"))
    lines = ones.select("d", F.posexplode(F.arrays_zip("h1", "h2")).alias("pos", "x")).select("d", "pos", "x.h1", "x.h2")
    levels = suffix_ranks(lines)
    if not levels:
        return copies
    found = materialize(lcp_intervals(levels))
    release(spark, *levels)
    names = ones.select("d", "i", "t", "u")
    longest = F.filter("found", lambda x, k: ~F.coalesce((F.get("found", k - 1)["pos"] == x["pos"] - 1) & (F.get("found", k - 1)["len"] > x["len"]), F.lit(False)))
    by_document = found.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("pos", "len", "source"))).alias("found")).select("d", F.posexplode(longest).alias("k", "x"))
    sourced = by_document.join(names.select(F.col("d").alias("_s"), F.col("i").alias("source_id")), F.col("x.source.d") == F.col("_s"))
    each = sourced.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("x.pos", "x.len", "source_id", F.col("x.source.pos").alias("source_pos")))).cast(RUNS).alias("runs"))
    out = materialize(each.join(names, "d").select("i", "t", "u", "runs").union(copies))
    release(spark, docs, ones, firsts, found)
    return out


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of df with the text that is left (null stays null), then n_lines (with a word) and n_removed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    runs = repeated_runs(df, key, text)
    df = df.drop("n_lines", "n_removed")
    names = df.columns
    at = names.index(text)
    fields = [StructField(f.name, StringType()) if f.name == text else f for f in df.schema.fields]
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for t, own in zip(batch[at].cast(pa.binary()), batch[len(names)].to_pylist(), strict=True):
                data = t.as_py()
                lines = _lines(data or b"")
                n = len(lines)
                words = np.cumsum([0, *(len(x.split()) for x in lines)]) if own else None
                edges = np.zeros(n + 1, np.int64)
                for r in own or ():
                    if words[r["pos"] + r["len"]] - words[r["pos"]] >= min_words:
                        edges[r["pos"]] += 1
                        edges[r["pos"] + r["len"]] -= 1
                goes = np.cumsum(edges)[:n] > 0
                if goes.any():
                    flags = iter(goes.tolist())
                    data = b"\n".join(x for x in data.split(b"\n") if not x.strip(b" \t\n\r\x0b\x0c") or not next(flags))
                texts.append(data)
                n_lines.append(n)
                n_removed.append(int(goes.sum()))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_removed)], schema=arrow)
            give_back()

    # a document finds its runs by id and by the hash of its text, taken again from the text itself
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_halves(t.as_py() or b"") for t in batch[at].cast(pa.binary())]
            extra = [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=tagged)

    own = StructType([*fields, StructField("_run_t", LongType()), StructField("_run_u", LongType())])
    tagged = to_arrow_schema(own)
    plain = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names])
    rows = plain.mapInArrow(tag, own).withColumn("_run_i", F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)))
    joined = rows.join(runs.select(F.col("i").alias("_run_i"), F.col("t").alias("_run_t"), F.col("u").alias("_run_u"), F.col("runs").alias("_runs")), ["_run_i", "_run_t", "_run_u"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], "_runs").mapInArrow(cut, schema)
