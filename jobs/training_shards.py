"""Batch job: de-duplicated, split and sharded training data with quality-controlled labels.

    python -m jobs.training_shards --documents D --labels L --benchmark B --out OUT --config jobs/training_shards.json

For a multi-task model that is pre-trained on sparse labels: texts that are the same but for case and white space are one
text, its least doc_id stays; a text that shares a run of overlap_words words with a benchmark item, or is the item, must
not be trained on and goes to validation, as does a hashed fraction of the others; the rest is dealt to training shards by key.
A task is a label in a language; tasks without enough labelled training rows (min_pos, min_neg, min_valid) are dropped:
their labels become null. Texts without a word are left out.

OUT/data has split=train|val and shard_id=k folders, each shard in a seeded pseudo-random order; OUT/tasks one JSON
line a task with its counts, kept and drop_reason; OUT/manifest the counts of the run. All are written anew by each run from the
inputs alone, so a rerun gives the same and a run that was cut short is repaired by the next.

Scale: keys, labels and routes are decided on digests and ids; whole texts are shuffled to meet their route (by doc_id, which no
group of copies makes hot) and to their shard. Copies are combined before the shuffle. Windows of documents meet the
benchmark's in a join that Spark broadcasts below its size threshold; keys and windows are made on Arrow batches (jobs/texts.py), each once a run. Shards of a large run are split with files_per_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobs.common import canonical_key, command_line, kept_settings, log, report, settings_of
from jobs.texts import run_batches
from marlstone.functions.keys import bucket, seeded_order
from marlstone.operators import corpus, labels as qc
from marlstone.session import written

DEFAULTS = {"labels": "quality,toxic", "train_shards": 8, "val_shards": 2, "files_per_shard": 1, "val_fraction": 0.1, "seed": 7, "overlap_words": 10, "min_pos": 5, "min_neg": 1, "min_valid": 8}
PATHS = {"documents": "Parquet of doc_id, text, lang, source", "labels": "Parquet of doc_id and label columns", "benchmark": "Parquet of text", "out": "folder for the result"}


def windows(df: DataFrame, keep: list[str], n: int) -> DataFrame:
    """keep and run: a hash of each run of n words of text."""
    rows = df.select(*keep, "text")
    return rows.mapInArrow(run_batches(keep, n), StructType([*rows.select(*keep).schema, StructField("run", LongType())]))


def overlapping(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """doc_id of documents that share a run of n words with an item."""
    runs = corpus.key_set(windows(benchmark, [], n), "run", "run")
    return corpus.key_set(corpus.only_listed(windows(docs, ["doc_id"], n), runs, "run"), "doc_id", "doc_id")


def routed(docs: DataFrame, benchmark: DataFrame, s: dict) -> DataFrame:
    """doc_id, raw (the text's digest), key, lang, source, copies (rows with the key), overlap, split, shard_id of the documents that stay."""
    keyed = docs.select("doc_id", "lang", "source", F.md5("text").alias("raw"), canonical_key(F.col("text")).alias("key"))
    first = corpus.keep_first(keyed, ["key"], ["doc_id", "raw", "lang", "source"], "copies")
    items = corpus.key_set(benchmark.select(canonical_key(F.col("text")).alias("key")), "key")
    flagged = corpus.flag_listed(corpus.flag_listed(first, items, "key", "same"), overlapping(docs, benchmark, s["overlap_words"]), "doc_id", "shares")
    flagged = flagged.withColumn("overlap", F.col("same") | F.col("shares")).drop("same", "shares")
    val = F.col("overlap") | (bucket(100, "key", F.lit(str(s["seed"]))) < int(s["val_fraction"] * 100))
    shard = F.when(F.col("split") == "val", bucket(s["val_shards"], "key")).otherwise(bucket(s["train_shards"], "key"))
    return flagged.withColumn("split", F.when(val, "val").otherwise("train")).withColumn("shard_id", shard)


def task_of(label: str):
    return F.concat_ws("/", F.lit(label), F.coalesce("lang", F.lit("")))


def run(spark: SparkSession, documents: str, labels: str, benchmark: str, out: str, settings: dict | None = None) -> DataFrame:
    """Does the job and returns OUT/data as it was written."""
    s = settings_of(settings or {}, DEFAULTS)
    names = [x.strip() for x in s["labels"].split(",")]
    with kept_settings(spark):
        docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").where("doc_id is not null")
        given = spark.read.parquet(labels)
        known = given.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(f"`{c}`").cast("int")).alias(c) for c in names])
        route = written(corpus.enrich(routed(docs, spark.read.parquet(benchmark), s), known, "doc_id"))

        train = route.where("split = 'train'")
        long = qc.melt(train, ["lang"], names, "label", "y").select(F.concat_ws("/", "label", F.coalesce("lang", F.lit(""))).alias("task"), "y")
        tasks = written(qc.filter_tasks(qc.task_stats(long), s["min_pos"], s["min_neg"], s["min_valid"]))
        tasks.coalesce(1).sort("task").write.mode("overwrite").json(f"{out}/tasks")
        kept = corpus.key_set(tasks.where("kept"), "task", "task")
        for c in names:
            route = corpus.flag_listed(route.withColumn("task", task_of(c)), kept, "task").withColumn(c, F.when(F.col("listed"), F.col(f"`{c}`"))).drop("task", "listed")

        # rows that repeat both id and text are one; the join goes by the same columns, so they cost no further shuffle
        texts = docs.select("doc_id", F.md5("text").alias("raw"), "text").dropDuplicates(["doc_id", "raw"])
        full = texts.join(route, ["doc_id", "raw"]).drop("raw", "copies").withColumn("_file", bucket(s["files_per_shard"], "key", F.lit("file")))
        ordered = full.repartition("split", "shard_id", "_file").sortWithinPartitions("split", "shard_id", "_file", seeded_order("key", s["seed"]), "key").drop("_file")
        ordered.write.mode("overwrite").partitionBy("split", "shard_id").option("compression", "zstd").parquet(f"{out}/data")

        # rows from the files' footers, rows with words from the counts of copies: no further scan of texts
        counts = spark.read.parquet(documents).agg(F.count("*").alias("rows_read")).crossJoin(F.broadcast(route.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("_keyed"))))
        counts = written(counts.select("rows_read", (F.col("rows_read") - F.col("_keyed")).alias("rows_without_id_or_words")))
        log.info("read %s: %s", documents, counts.first().asDict())
        split = {f"{x}_rows": F.count_if(F.col("split") == x) for x in ("train", "val")}
        data = spark.read.schema(full.drop("_file").schema).parquet(f"{out}/data")  # an empty table has no files to learn it from
        wrote = report(data, f"{out}/data", "data", split | {"val_rows_of_overlap": F.count_if("overlap"), "shards": F.countDistinct("split", "shard_id")})
        log.info("tasks: %s", tasks.agg(F.count("*").alias("tasks"), F.count_if("kept").alias("kept")).first().asDict())
        counts.withColumns({k: F.lit(v) for k, v in wrote.items()}).coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return data


if __name__ == "__main__":
    command_line(__doc__.partition("\n")[0], PATHS, DEFAULTS, run)
