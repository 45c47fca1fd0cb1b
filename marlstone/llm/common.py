"""Shared pieces: the scratch store, text primitives, hashing and packed integer arrays.

Words are maximal runs of anything but ASCII white space unless an operator says otherwise.
"""

from __future__ import annotations

import gc
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import guard, scratch_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "[\\x20\\x09-\\x0D]+"
IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
NULL_ID = np.iinfo(np.int64).max  # a null document id sorts after all others
SCRATCH: set[str] = set()  # tables of this driver that are not deleted yet
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ----------------------------------------------------------------- scratch tables
def held_dir(spark: SparkSession) -> str:
    """A new scratch folder under spark.checkpoint.dir; it goes with sweep, or else when the driver ends."""
    path = scratch_folder(spark)
    SCRATCH.add(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared scratch store and read it back: cuts the lineage, and lost executors cost nothing."""
    path = held_dir(guard(df.sparkSession))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    SCRATCH.discard(path)


def held() -> frozenset[str]:
    """The scratch tables there are, to be given to sweep."""
    return frozenset(SCRATCH)


def sweep(spark: SparkSession, before: frozenset[str], *keep: DataFrame) -> None:
    """Delete the scratch tables made since held() gave before, but for keep."""
    for path in SCRATCH - before - {df._scratch for df in keep}:
        _delete(spark, path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        _delete(spark, df._scratch)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """drop, and let Spark drop the shuffle files of finished jobs: a full collection, so not for every small step."""
    drop(spark, *tables)
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ----------------------------------------------------------------- columns
def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """The words between separators (a regular expression); null text has none."""
    words = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(words, lambda w: w != "")


def count_words(text: Column, separators: str) -> Column:
    """How many words split_words gives, without making them: only the first and the last part can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return let(parts, lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int"))


def words_for_text(df: DataFrame, text: str, name: str) -> DataFrame:
    """df without its string column text and with name, the number split_words gives for it by SPACES, counted over the bytes
    of many texts at once: a regular expression of the JVM costs several times as much."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = df.drop(text).withColumn(name, F.lit(0).cast("long")).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            texts = batch[-1].cast(pa.large_binary()).fill_null(b"")
            counts = [count_in_bytes(texts.slice(at, 256)) for at in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.empty(0, np.int64), *counts]))], schema=arrow)
            del batch, texts
        give_back()

    return df.select(*[f"`{c}`" for c in df.columns if c != text], text).mapInArrow(run, out)


def count_in_bytes(texts: pa.LargeBinaryArray) -> np.ndarray:
    """How many words each of the texts has (none of them null), by SPACES: places where a word begins."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    begins = ends - ends[0]
    inside = IN_WORD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = begins[:-1][begins[:-1] < begins[1:]]
    first[edges] = inside[edges]  # a word does not go on from one text to the next
    return np.diff(np.searchsorted(np.flatnonzero(first), begins))


def crc_fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


# ----------------------------------------------------------------- numpy hashing
def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def spread(total: int, counts: np.ndarray) -> np.ndarray:
    """Group number of each of total rows, from the size of each group."""
    return np.repeat(np.arange(len(counts)), counts)


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Start positions of all k-word windows that stay inside their document."""
    if not len(counts):
        return np.empty(0, np.int64)
    starts = np.cumsum(counts) - counts
    inside = np.maximum(counts - k + 1, 0)
    first = np.repeat(starts - (np.cumsum(inside) - inside), inside)
    return first + np.arange(inside.sum())


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of the k items from each position."""
    n = max(0, len(hashes) - k + 1)
    dense = 2 * len(at) > n  # then all positions are hashed in place, and those asked for are taken
    out = np.zeros(n if dense else len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (hashes[j : j + n] if dense else hashes[at + j]) + np.uint64(salt + j + 1))
    return out[at] if dense else out


# ----------------------------------------------------------------- sorted codes
def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among the distinct ones, and those in ascending order."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(ordered), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, ordered[new]


# ----------------------------------------------------------------- packed integers
def pack(values: np.ndarray) -> bytes:
    """Non-negative integers: width, length, then planes of equal significance side by side, compressed."""
    values = np.ascontiguousarray(values)
    values = values.view(f"u{values.itemsize}") if values.dtype.kind in "iu" else values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.empty((width, len(values)), np.uint8)
    for j in range(width):
        planes[j] = (values >> values.dtype.type(8 * j)).astype(np.uint8)
    return bytes([width]) + len(values).to_bytes(6, "little") + squeeze(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:7], "little")
    planes = np.frombuffer(expand(data[7:], width * n), np.uint8).reshape(width, n)
    out = planes[0].astype(np.uint64)
    for j in range(1, width):
        out |= planes[j].astype(np.uint64) << np.uint64(8 * j)
    return out


def squeeze(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True) if data else b""


def expand(data: bytes, size: int) -> bytes:
    """What squeeze was given; size: its length."""
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as gaps."""
    return pack(np.diff(np.asarray(values, np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def give_back() -> None:
    """Return freed memory to the system: workers are kept between stages, and what they hold adds up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files lie on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
