"""Scans: tables, globs, discovery of files and label columns, nested results, small dimensions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import shard_of_path


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """SRC-01, SRC-05: one Parquet table, pruned to columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def view(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """SRC-01, SRC-04: a lazy view over a glob."""
    df = spark.read.parquet(pattern)
    df.createOrReplaceTempView(name)
    return df


def discover(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """SRC-02: all files below folder; an error without any."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(folder)
    if not df.inputFiles():
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return df


def label_columns(df: DataFrame, prefix: str) -> list[str]:
    """SRC-05, SRC-21: by name, from the schema alone."""
    return [c for c in df.columns if c.startswith(prefix)]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-06, PRJ-06: exactly these columns; KeyError names those that are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def as_floats(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-04: bulk cast of dynamic columns."""
    return df.withColumns({c: F.col(f"`{c}`").cast("float") for c in columns})


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-12, SRC-13: with header; a schema avoids a second scan."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-08."""
    return spark.read.schema(schema).json(path)


def keys_file(spark: SparkSession, path: str, name: str = "key") -> DataFrame:
    """SRC-22: one key a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.length(name) > 0)


def with_retry(read, tries: int = 5, wait: float = 1.0):
    """SRC-10: read() again after a failure, waiting twice as long each time; the last failure is raised."""
    import time

    for k in range(tries):
        try:
            return read()
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)


def union_of_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """SRC-10, SET-06: rows of all splits, with the split's name, in order of name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [splits[k].withColumn("split", F.lit(k)) for k in sorted(splits)])


def keys_by(df: DataFrame, group: str, key: str) -> DataFrame:
    """SRC-10: sorted distinct keys of each split or task."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def row_batches(df: DataFrame, columns: list[str], rows: int):
    """SRC-07: the named columns alone, some rows at a time, one partition in memory: an iterator of lists of rows."""
    batch = []
    for r in df.select(*columns).toLocalIterator(prefetchPartitions=True):
        batch.append(r)
        if len(batch) == rows:
            yield batch
            batch = []
    if batch:
        yield batch


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-20: rows with the number of the shard file they come from."""
    df = spark.read.parquet(folder)
    return df.withColumn("shard", shard_of_path(F.col("_metadata.file_name")))


def split_last(df: DataFrame, shard: str = "shard") -> tuple[DataFrame, DataFrame]:
    """SRC-20: training rows and those of the last shard."""
    last = df.agg(F.max(shard)).first()[0]
    return df.where(F.col(shard) != last), df.where(F.col(shard) == last)


CUBE = "map<string, map<string, map<string, double>>>"


def explode_cube(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """SRC-16, JSN-01: a JSON result cube {seed: {task: {metric: value}}} to facts; unparsable text gives none."""
    cube = df.select(*keys, F.from_json(text, CUBE).alias("c"))
    seeds = cube.select(*keys, F.explode("c").alias("seed", "t"))
    tasks = seeds.select(*keys, "seed", F.explode("t").alias("task", "m"))
    return tasks.select(*keys, "seed", "task", F.explode("m").alias("metric", "value"))


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-16, SRC-24: facts of all result files of a folder (<method>.json, or <method>/results.json where
    there is none of the first kind), files with a leading underscore left out; method is the name."""
    for pattern, part in ((f"{folder}/*.json", r"([^/]+)\.json$"), (f"{folder}/*/results.json", r"([^/]+)/results\.json$")):
        try:
            files = spark.read.text(pattern, wholetext=True)
            files = files.withColumn("method", F.regexp_extract(F.input_file_name(), part, 1))
            files.schema
        except Exception as e:  # noqa: BLE001  a pattern without files
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        return explode_cube(files.where(~F.col("method").startswith("_")), "value", ["method"])
    return spark.createDataFrame([], "method string, seed string, task string, metric string, value double")


def cube_json(facts: DataFrame, keys: list[str]) -> DataFrame:
    """JSN-01: the inverse of explode_cube, one JSON text for each keys; a cube is small."""
    values = F.sort_array(F.collect_list(F.struct("seed", "task", "metric", "value")))
    listed = facts.groupBy(*keys).agg(values.alias("v"))
    inner = F.transform(F.array_distinct(F.transform("v", lambda x: x["seed"])), lambda s: F.struct(s.alias("seed"), F.filter("v", lambda x: x["seed"] == s).alias("own")))
    by_task = lambda own: F.map_from_entries(F.transform(F.array_distinct(F.transform(own, lambda x: x["task"])), lambda t: F.struct(t, F.map_from_entries(F.transform(F.filter(own, lambda x: x["task"] == t), lambda x: F.struct(x["metric"], x["value"]))))))
    cube = F.map_from_entries(F.transform(inner, lambda s: F.struct(s["seed"], by_task(s["own"]))))
    return listed.select(*keys, F.to_json(cube).alias("json"))


def leaf(cube: Column, *path: str, default: float | None = None) -> Column:
    """MAP-02: the value below nested map keys, default where a key is absent."""
    for k in path:
        cube = F.try_element_at(cube, F.lit(k))
    return F.coalesce(cube, F.lit(default))


def keyed_cache(parts: list[DataFrame], key: str, clear: bool) -> DataFrame:
    """SRC-15, SRC-23: one row a key of cache tables read one after another: with clear the last table alone, else the first
    table that has a key; within a table the least row by its other columns."""
    from ..operators.corpus import merge_keep_first

    return merge_keep_first(parts[-1:] if clear else parts, [key])


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """SRC-17, JOI-15: a fixed small table."""
    return spark.createDataFrame(rows, schema)


def json_dimension(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: a JSON object {key: value} or {key: {name: value}} of a small asset, as key and JSON text."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in json.loads(text).items()], "key string, value string")


def gaps_to(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """SRC-18: text cells to numbers, gaps to defaults."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(d)) for c, d in defaults.items()})


def with_positions(df: DataFrame, order: Column) -> DataFrame:
    """JOI-06: a stable position column for later scatter."""
    return df.withColumn("pos", order)


def text_records(spark: SparkSession, path: str, separator: str, name: str = "record") -> DataFrame:
    """SRC-14: records of a text file that end with a separator line (as in structure files), blank ones left out."""
    raw = spark.read.option("lineSep", separator + "\n").text(path)
    return raw.select(F.regexp_replace("value", "^\\n|\\n$", "").alias(name)).where(F.length(F.trim(name)) > 0)


def grouped_records(records: DataFrame, key: Column, record: str = "record") -> DataFrame:
    """SRC-14, JOI-18: records by key, in a fixed order."""
    return records.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(record)).alias("records"))


def structure_records(spark: SparkSession, path: str, separator: str = "$$$$") -> DataFrame:
    """SRC-14: records of structure files: title (first line), block (all up to the first property) and properties, a map of what
    stands below the lines "> <name>", trimmed; of a name that repeats, the first counts.

    A record ends with a line that is the separator, alone. The text reader finds it wherever file splits fall, so one large
    file is read by many tasks; a record that crosses splits is read by the task in whose split it begins. Blank records are left out."""
    raw = spark.read.option("lineSep", f"\n{separator}\n").text(path)
    last = f"(^|\\n){''.join(chr(92) + c for c in separator)}\\s*$"  # of a file without a line feed at its end, or with no record before
    record = F.regexp_replace(F.regexp_replace("value", last, ""), "^\\n+", "")
    parts = F.split("r", "\n> +(?=<)|\n>  +(?=.*<)")
    named = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.struct(F.regexp_extract(x, "<([^>]*)>", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(x, "^[^\\n]*\\n?", ""), "\\s+$", "")).alias("v")))
    first = F.filter("n", lambda x, i: ~F.exists(F.slice("n", 1, i), lambda y: y["k"] == x["k"]))
    rows = raw.select(record.alias("r")).where(F.length(F.trim(F.regexp_replace("r", "\\s+", ""))) > 0).select("r", parts.alias("p")).select("p", named.alias("n"))
    return rows.select(F.substring_index(F.get("p", F.lit(0)), "\n", 1).alias("title"), F.get("p", F.lit(0)).alias("block"), F.map_from_entries(first).alias("properties"))


def array_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: .npy files of one or two dimensions as (file, row, values)."""

    def read(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                a = a.reshape(len(a), -1)
                for at in range(0, len(a), 4096):
                    part = a[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["file", "row", "values"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1), "content").mapInArrow(read, "file string, row long, values array<double>")
