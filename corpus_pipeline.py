"""The corpus pipeline: five stages from documents to packed training bins.

Every stage but the last returns the columns of documents: toxicity drops the documents it
rejects; line dedup deletes repeated line runs, however short (a document that loses all its lines
goes, and n_chars follows the text); the n-gram Jaccard join keeps one document of each group;
benchmark decontamination drops documents with a window of a benchmark item;
best-fit packing returns one row for each piece of each document. Of a group of near copies the join
has left one document, so packing needs no clusters of them.

Rows are judged by themselves, not by their ids: a row is told apart by its id and the hash of its text. A row with a
null or repeated id is dropped only for its own text. Of a group the row with the smallest id stays (null ids
come last, then the text's hash decides; of rows alike in id and text one stays); rows without a word belong to no
group and all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from marlstone.llm.common import crc_fold, held, materialize, release, sweep, words_for_text


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold(F.col("doc_id"), 4) != 2)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(docs, min_words=1).where("n_lines = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    worded = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    rows = docs.where(worded).withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.jaccard_components(rows.select("_row", "text"), key="_row")
    ids = rows.select("_row", "doc_id").distinct()
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    stays = groups.select("_row", "component_id").distinct().join(ids, "_row").groupBy("component_id").agg(F.min(first).alias("f")).select("f._row")
    kept = rows.join(stays, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
    return kept.union(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_bad_id"), "text_hash").distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = words_for_text(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("cluster")), "text", "n")
    return packing.best_fit(rows, F.col("n"), F.col("source"), F.col("cluster"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity is a learned score and packing a sequential rule: SQL states neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = held()
        kept = materialize(stage(spark, docs, sf_dir))
        sweep(spark, before, kept)
        if hasattr(docs, "_scratch"):
            release(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
