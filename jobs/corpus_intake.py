"""Incremental job: new files of documents are added to a de-duplicated, sharded corpus.

    python -m jobs.corpus_intake --documents D --benchmark B --out OUT --checkpoint CP --config jobs/corpus_intake.json

Document files land in folder D (D may be a pattern, too, of files or folders). Each run takes the files that no earlier run has taken: a file stream with an
availableNow trigger, whose checkpoint CP remembers them. Of a text (the same but for case and white space) the first arrival stays,
of one batch the row with the least doc_id; texts that are benchmark items, and texts without a word, are left out.

OUT/ledger/batch=k has the keys that batch k added, OUT/corpus/batch=k/shard_id=j their texts, OUT/log/batch=k one JSON line of
counts. A batch compares itself with the ledger of earlier batches only and writes its own three folders whole, so a batch that
is run again after a crash, or by a lost checkpoint's replay of the same files, gives the same rows again; a run without new files
changes nothing. Batches are split by max_files files (0: all that is there), which bounds the size of one.

Scale: the corpus is never read again, only the 32-character keys of the ledger. Keys of the batch are looked up in it, so it is the
new keys that Spark broadcasts when they are few, and the ledger is then scanned without a shuffle; otherwise both meet by key, which
is unique on either side. Copies are combined before they are shuffled; texts are shuffled once to meet their verdict, once to their shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import canonical_key, command_line, kept_settings, log, report, settings_of
from marlstone.functions.keys import bucket
from marlstone.operators import corpus
from marlstone.session import written

DEFAULTS = {"shards": 8, "max_files": 0}
PATHS = {"documents": "folder, or pattern, where Parquet files of doc_id, text, lang, source arrive", "benchmark": "Parquet of text", "out": "folder of the corpus", "checkpoint": "folder of the stream's checkpoint"}
ROWS = "doc_id long, text string, lang string, source string"
LEDGER = "key string, doc_id long, raw string, lang string, source string"
CORPUS = f"doc_id long, {LEDGER.replace(', doc_id long, raw string', '')}, text string, batch long, shard_id int"


def keys_of(rows: DataFrame) -> DataFrame:
    """The row of each key of a batch that would be added, and copies: how many had it."""
    keyed = rows.select("doc_id", "lang", "source", F.md5("text").alias("raw"), canonical_key(F.col("text")).alias("key")).where("doc_id is not null")
    return written(corpus.keep_first(keyed, ["key"], ["doc_id", "raw", "lang", "source"], "copies"))


def fresh_keys(first: DataFrame, excluded: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The ledger rows that a batch adds."""
    new = corpus.drop_listed(first, excluded, "key")
    if ledger is not None:
        new = corpus.drop_listed(new, corpus.only_listed(ledger.select("key"), first.select("key"), "key"), "key")
    return new.select("key", "doc_id", "raw", "lang", "source")


def take(rows: DataFrame, batch: int, benchmark: DataFrame, out: str, s: dict) -> None:
    """Adds one batch."""
    spark = rows.sparkSession
    excluded = corpus.key_set(benchmark.select(canonical_key(F.col("text")).alias("key")), "key")
    ledger = spark.read.schema(f"{LEDGER}, batch long").parquet(f"{out}/ledger").where(F.col("batch") < batch) if batch else None
    first = keys_of(rows)
    fresh_keys(first, excluded, ledger).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch}")
    added = spark.read.schema(LEDGER).parquet(f"{out}/ledger/batch={batch}")
    texts = rows.select("doc_id", F.md5("text").alias("raw"), "text").dropDuplicates(["doc_id", "raw"])
    full = texts.join(added, ["doc_id", "raw"]).select("doc_id", "key", "lang", "source", "text", bucket(s["shards"], "key").alias("shard_id"))
    full.repartition("shard_id").sortWithinPartitions("shard_id", "key").write.mode("overwrite").partitionBy("shard_id").option("compression", "zstd").parquet(f"{out}/corpus/batch={batch}")
    n = report(added, f"{out}/ledger/batch={batch}", f"batch {batch}")["rows"]
    keyed = first.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("_keyed"))  # no further scan of texts
    read = rows.agg(F.count("*").alias("read")).crossJoin(F.broadcast(keyed)).select("read", (F.col("read") - F.col("_keyed")).alias("without_id_or_words"), F.lit(n).alias("added"))
    read.coalesce(1).write.mode("overwrite").json(f"{out}/log/batch={batch}")
    log.info("batch %s: %s", batch, spark.read.json(f"{out}/log/batch={batch}").first().asDict())


def corpus_of(spark: SparkSession, out: str) -> DataFrame:
    """All that was ever added."""
    return spark.read.schema(CORPUS).parquet(f"{out}/corpus")


def run(spark: SparkSession, documents: str, benchmark: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Takes what is new, waits for the end and returns the whole corpus."""
    s = settings_of(settings or {}, DEFAULTS)
    with kept_settings(spark):
        items = spark.read.parquet(benchmark)
        reader = spark.readStream.schema(ROWS).option("maxFileAge", "36500d")  # a late file may be old
        stream = (reader.option("maxFilesPerTrigger", s["max_files"]) if s["max_files"] else reader).parquet(documents)
        query = stream.writeStream.foreachBatch(lambda rows, k: take(rows, k, items, out, s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        log.info("read %s: %d rows in %d batches that are new", documents, sum(p["numInputRows"] for p in query.recentProgress), sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return corpus_of(spark, out)


if __name__ == "__main__":
    command_line(__doc__.partition("\n")[0], PATHS, DEFAULTS, run)
