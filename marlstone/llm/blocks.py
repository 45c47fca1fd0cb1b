"""Token blocks: some megabytes of documents as one row of distinct words and word numbers.

A block is made once, written to the shared store, and then read by every later pass, so
that text is split and hashed once and numpy works on whole arrays. Blocks are bounded by
block_size of text (one longer text makes a block of its own).

Passes ask questions about items (windows, n-grams, shingles) of all blocks in two steps,
both linear in the input: a block sends each of its distinct items once to the owner of the
item's hash range, and the owner answers to the block with one bit or count an item. A
frequent item therefore reaches its owner at most once a block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expand, give_back, pack, squeeze, unpack

BLOCK_BYTES, MOST_BYTES = 4 << 20, 128 << 20
SCHEMA = "block long, ids array<bigint>, flags array<int>, words long, counts binary, vocabulary binary, codes binary"


class Block:
    """One decoded row: ids (None allowed), words per document, distinct words, word numbers."""

    def __init__(self, row: dict):
        self.block, self.ids, self.flags = row["block"], row["ids"], row["flags"]
        self.counts = unpack(row["counts"]).astype(np.int64)
        self._vocabulary, self._codes = row["vocabulary"], row["codes"]
        self.starts = np.cumsum(self.counts) - self.counts

    @property
    def vocabulary(self) -> list[bytes]:
        size = int.from_bytes(self._vocabulary[:6], "little")
        return expand(self._vocabulary[6:], size).split(b"\n") if size else []

    @property
    def codes(self) -> np.ndarray:
        return unpack(self._codes).astype(np.int64)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit hash of each word in place."""
        words = self.vocabulary
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(salt)), np.uint64, len(words))
        return own[self.codes] if len(own) else np.empty(0, np.uint64)

    def numbers(self, null: int) -> np.ndarray:
        return np.fromiter((null if x is None else x for x in self.ids), np.int64, len(self.ids))

    def document(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _encode(block: int, ids: list, flags: list, texts: pa.LargeStringArray) -> dict:
    trimmed = pc.ascii_trim_whitespace(texts)
    split = pc.ascii_split_whitespace(trimmed)
    blank = pc.binary_length(trimmed).to_numpy() == 0
    counts, words = np.where(blank, 0, pc.list_value_length(split).to_numpy()), split.flatten()
    if blank.any():  # the split of an empty text is one empty word
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    coded = words.dictionary_encode()
    lines = pc.binary_join_element_wise(coded.dictionary, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))  # no word holds a line feed
    joined = lines.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(lines)).as_py() - 1] if len(lines) else b""
    return {"block": block, "ids": ids, "flags": flags, "words": len(words), "counts": pack(counts), "vocabulary": len(joined).to_bytes(6, "little") + squeeze(joined), "codes": pack(coded.indices.to_numpy())}


def block_size(spark: SparkSession) -> int:
    """BLOCK_BYTES, or more on executors with much memory for each core: a block costs about a hundred times its size while it
    is worked on. Rows between blocks and owners grow with the square of the number of blocks, so large inputs want large ones."""
    memory = spark.sparkContext._jsc.sc().executorMemory() << 20
    cores = int(spark.conf.get("spark.executor.cores", "8"))
    return min(MOST_BYTES, max(BLOCK_BYTES, memory // cores // 400))


def to_blocks(df: DataFrame, key: str, text: str, flag=None, lower: bool = False, block_bytes: int | None = None) -> DataFrame:
    """Rows of df as blocks. flag: an integer column expression kept per document; lower: A-Z to a-z; block_bytes: block_size if not given."""
    block_bytes = block_bytes or block_size(df.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.int32())), ("words", pa.int64()), ("counts", pa.binary()), ("vocabulary", pa.binary()), ("codes", pa.binary())])
        held, size = [], 0  # slices of batches, and their bytes

        def out() -> pa.RecordBatch:
            ids, flags = ([x for b in held for x in b[c].to_pylist()] for c in (0, 1))
            texts = pa.concat_arrays([b[2].cast(pa.large_string()).fill_null("") for b in held])
            return pa.RecordBatch.from_pylist([_encode((part << 32) | seq, ids, flags, pc.ascii_lower(texts) if lower else texts)], schema)

        for batch in batches:
            begin = 0
            for end, n in enumerate(pc.binary_length(batch[2]).to_pylist(), 1):
                size += (n or 0) + 16
                if size >= block_bytes:
                    held.append(batch.slice(begin, end - begin))
                    yield out()
                    seq, held, size, begin = seq + 1, [], 0, end
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield out()
        held = []
        give_back()

    flag = F.lit(0) if flag is None else F.coalesce(flag.cast("int"), F.lit(0))
    return df.select(F.col(key).cast("long").alias("k"), flag.cast("int").alias("f"), F.col(text).cast("string").alias("t")).mapInArrow(make, SCHEMA)


def map_blocks(blocks: DataFrame, fn: Callable[[Block], Iterator[dict]], schema: str) -> DataFrame:
    """fn over each block of a table of blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                if rows := list(fn(block)):
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                del block, rows
                give_back()

    return blocks.mapInArrow(run, schema)


def join_blocks(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, dict], Iterator[dict]], schema: str) -> DataFrame:
    """fn(block, {(kind, owner): data}) over each block with the answers addressed to it.

    answers: block long, kind int, owner int, data binary."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)

    def run(left, right):
        got = {(r["kind"], r["owner"]): r["data"] for r in right.to_pylist()}
        out = pa.Table.from_pylist([x for r in left.to_pylist() for x in fn(Block(r), got)], arrow)
        del got
        give_back()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


ASK = "owner int, block long, kind int, data binary"
ANSWER = "block long, kind int, owner int, data binary"


def answer(asked: DataFrame, fn: Callable[[int, list[dict]], Iterator[dict]], schema: str = ANSWER) -> DataFrame:
    """fn(owner, rows asked) for each owner of a hash range."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(asked.sparkSession.createDataFrame([], schema).schema)

    def run(key, table):
        out = pa.Table.from_pylist(list(fn(key[0].as_py(), table.to_pylist())), arrow)
        give_back()
        return out

    return asked.groupBy("owner").applyInArrow(run, schema)


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Range of the top 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def by_owner(sorted_hashes: np.ndarray, owners: int) -> list[tuple[int, slice]]:
    """(owner, slice) of ascending hashes."""
    own = owner_of(sorted_hashes, owners).astype(np.int64)
    cuts = np.flatnonzero(np.diff(own)) + 1
    edges = np.concatenate([[0], cuts, [len(own)]])
    return [(int(own[a]), slice(int(a), int(b))) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def owners_for(blocks: DataFrame, per_owner: int = 8) -> int:
    """Hash ranges for the questions of a table of blocks: several a shuffle partition, and at least one
    for every per_owner blocks, so that an owner's share stays the same as the input grows. Larger
    inputs want larger blocks (block_bytes), which keeps many items in each block's row to an owner."""
    from .common import partitions

    return max(3 * partitions(blocks.sparkSession), blocks.count() // per_owner)


def bundle(*parts: bytes) -> bytes:
    """Byte strings as one, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundle(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out
