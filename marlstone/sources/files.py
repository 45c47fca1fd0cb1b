"""Plain files from executors: array files, atomic writes, work claims. Paths are URIs as Spark writes them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes of Spark's file systems by the name pyarrow has for them.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "wasbs://": "abfss://"}


def located(path: str):
    """(file system, path in it, scheme and host to be put before such paths) of a URI or local path, by pyarrow."""
    import pyarrow.fs as pafs

    for theirs, ours in SCHEMES.items():
        if path.startswith(theirs):
            path = ours + path[len(theirs) :]
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner, path[: len(path) - len(inner)]


def open_uri(path: str, mode: str):
    """A file of any file system that pyarrow and Spark both reach, for reading ("r") or writing ("w")."""
    fs, inner, _ = located(path)
    if mode == "r":
        return fs.open_input_file(inner)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(inner, compression=None)


def write_array_files(df: DataFrame, folder: str, shard: str, order: str, values: str, flush: int = 4096) -> DataFrame:
    """SNK-05, SNK-09: one .npy file a shard, rows in order, flushed every so many rows; returns shard, path and rows.

    A file is written under a name of its own try, so a retried task leaves an unread file at worst, and a failed
    one is deleted. Shards are the unit of writing."""
    import pyarrow as pa

    def write(key, table):
        import numpy as np

        rows = table.sort_by(order)[values]
        width = len(rows[0].as_py())
        path = f"{folder}/{key[0].as_py()}-{uuid.uuid4().hex}.npy"
        try:
            with open_uri(path, "w") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (len(rows), width)})
                for at in range(0, len(rows), flush):
                    out.write(np.array(rows.slice(at, flush).to_pylist(), "<f8").tobytes())
                    out.flush()
        except Exception:
            fs, inner, _ = located(path)
            fs.delete_file(inner)
            raise
        return pa.table({"shard": [str(key[0].as_py())], "path": [path], "n": pa.array([len(rows)], pa.int64())})

    return df.select(shard, order, values).groupBy(shard).applyInArrow(write, "shard string, path string, n long")


def claim(spark: SparkSession, folder: str, items: list[str], finished: str | None = None) -> list[str]:
    """STM-04: the items that this caller may work on: not finished (a file of that name below finished), and whose
    lock it was the first to create. The file system makes the lock file or fails, so two callers never share an item."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(folder))
    won = []
    for x in items:
        if finished is not None and fs.exists(path(f"{finished}/{x}")):
            continue
        lock = path(f"{folder}/{x}.lock")
        try:
            fs.create(lock, False).close()
            won.append(x)
        except Exception as e:  # noqa: BLE001  the lock of another caller
            if not fs.exists(lock):
                raise RuntimeError(f"cannot claim {x}") from e
    return won


def release_claims(spark: SparkSession, folder: str, items: list[str]) -> None:
    """STM-04: gives items back."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for x in items:
        path(f"{folder}/{x}.lock").getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{folder}/{x}.lock"), False)


def file_names(df: DataFrame) -> DataFrame:
    """SRC-06: rows and file of each Parquet file, from the footers where nothing else is read."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
