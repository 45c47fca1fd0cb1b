"""Writers: sharded Parquet, manifests, quarantine, keyed results, Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import seeded_order
from ..operators.corpus import upsert
from ..session import written

JSON_ROWS = 100_000  # a JSON list is for small tables; more is an error, not a cut


def write_shards(df: DataFrame, path: str, key: str, seed: int | None = None, shard: str = "shard_id", compression: str = "zstd") -> None:
    """SNK-01, SNK-02: one shuffle to shard_id=k folders; rows by key, or in seeded order."""
    order = [seeded_order(key, seed), F.col(key)] if seed is not None else [F.col(key)]
    df.repartition(shard).sortWithinPartitions(shard, *order).write.mode("overwrite").partitionBy(shard).option("compression", compression).parquet(path)


def write_split(df: DataFrame, path: str, key: str) -> None:
    """SNK-02: folders by is_val and shard_id."""
    df.repartition("is_val", "shard_id").sortWithinPartitions("is_val", "shard_id", key).write.mode("overwrite").partitionBy("is_val", "shard_id").option("compression", "zstd").parquet(path)


def write_rows_per_file(df: DataFrame, path: str, rows: int) -> None:
    """SNK-12."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file through Hadoop's file systems, whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = to.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(to), options)


def write_manifest(row: DataFrame, path: str, **parameters) -> dict:
    """SNK-03: one row of statistics and the parameters as JSON."""
    manifest = row.first().asDict() | parameters
    _put(row.sparkSession, path, json.dumps(manifest, indent=2, default=str))
    return manifest


def write_json_sorted(df: DataFrame, path: str, by: str) -> None:
    """SNK-04: a small table as a JSON list in order of a column."""
    rows = df.orderBy(by).select(F.to_json(F.struct("*"))).limit(JSON_ROWS + 1).collect()
    if len(rows) > JSON_ROWS:
        raise ValueError(f"more than {JSON_ROWS} rows do not belong in one JSON file")
    _put(df.sparkSession, path, json.dumps([json.loads(r[0]) for r in rows], indent=2))


def write_with_quarantine(df: DataFrame, good: str, bad: str, error: str = "error") -> None:
    """SNK-06: rows with an error apart from the others; df is computed once, whatever becomes of executors."""
    kept = written(df)
    kept.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(good)
    kept.where(F.col(error).isNotNull()).write.mode("overwrite").parquet(bad)


def merge_shards(spark: SparkSession, paths: list[str], to: str, files: int) -> None:
    """SNK-08, SNK-11, SET-08: consolidates shards into fewer files."""
    spark.read.parquet(*paths).coalesce(files).write.mode("overwrite").parquet(to)


def upsert_parquet(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """SNK-13, SNK-10, FIL-17: replaces the rows of new's keys in a table, which is made if absent.

    Every version has a folder of its own, and the pointer file current.txt, renamed into place, names the one that
    counts: a crash leaves the old version readable. The version before the last is deleted. One writer at a time: of two at once, one is lost."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = where("current.txt").getFileSystem(conf)
    old = current_version(spark, path)
    version = 0 if old is None else old + 1
    out = new if old is None else upsert(spark.read.parquet(f"{path}/v{old}"), new, keys)
    out.write.mode("overwrite").parquet(f"{path}/v{version}")
    _put(spark, f"{path}/current.txt", str(version))
    if version > 1:
        fs.delete(where(f"v{version - 2}"), True)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The version that the pointer of an upserted table names, the newest complete one if the pointer is lost, None without any."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")):
        return int(spark.read.text(f"{path}/current.txt").first()[0])
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")) or []
    return max((int(x.getPath().getParent().getName()[1:]) for x in found), default=None)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """SNK-13: the table of upsert_parquet."""
    if (version := current_version(spark, path)) is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{version}")


def write_markdown(spark: SparkSession, path: str, text: str) -> None:
    """SNK-14."""
    _put(spark, path, text)


def log_metrics(batch: DataFrame, batch_id: int, path: str) -> None:
    """SNK-16: a foreachBatch sink that may repeat a batch without repeating rows: each has its own folder."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
