"""The Spark session the engine expects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    # Spark 4.1 takes a union of tables dealt by one key to be dealt by it, though adaptive execution may have merged the
    # partitions of one side only; an aggregate above it then gives a key twice
    "spark.sql.unionOutputPartitioning": "false",
}


def guard(spark: SparkSession) -> SparkSession:
    """The one default that results depend on, for sessions made elsewhere."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf keys use _ for . (as in spark_ui_enabled) and override them."""
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("_", "."): str(v) for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def new_folder(spark: SparkSession, name: str = "marlstone") -> str:
    """The path of a new folder below spark.checkpoint.dir, which stays; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_HOMES: dict[tuple, str] = {}  # this driver's scratch, by JVM and base folder


def scratch_folder(spark: SparkSession) -> str:
    """The path of a new folder in this driver's scratch, which is deleted when the driver ends."""
    home = new_folder(spark, "marlstone")
    at = (id(spark._jvm), home.rpartition("/")[0])
    if at not in _HOMES:
        where = spark._jvm.org.apache.hadoop.fs.Path(home)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        if not fs.deleteOnExit(where):  # it takes folders that exist only
            raise OSError(f"{home} cannot be made")
        _HOMES[at] = home
    return f"{_HOMES[at]}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df from a scratch table: computed once, and lost executors cost nothing."""
    path = scratch_folder(guard(df.sparkSession))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
