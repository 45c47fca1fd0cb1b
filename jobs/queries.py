"""The jobs as queries, each with the SQL of its whole output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import corpus_intake, training_shards
from marlstone.session import new_folder


def job1_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run twice into one folder: the second run writes all anew."""
    out = new_folder(spark, "job1")
    for _ in range(2):
        data = training_shards.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{sf_dir}/benchmark.parquet", out)
    return data.select("doc_id", "key", "lang", "source", F.md5("text").alias("text_md5"), "overlap", "split", F.col("shard_id").cast("int").alias("shard_id"), "quality", "toxic")


def job2_corpus_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run twice into one folder and checkpoint: the second run finds nothing new."""
    out = new_folder(spark, "job2")
    for _ in range(2):  # a pattern, as the table may be one file or a folder of files
        data = corpus_intake.run(spark, f"{sf_dir}/documents.parquet*", f"{sf_dir}/benchmark.parquet", f"{out}/corpus", f"{out}/checkpoint")
    return data.select("doc_id", "key", "lang", "source", F.md5("text").alias("text_md5"), "shard_id")


_PLAIN = "trim(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"
_BUCKET = "(('0x' || substr(md5({}), 1, 8))::BIGINT % {})::INTEGER"
_FIRST = f"""t AS (SELECT doc_id, lang, source, md5(text) AS text_md5, {_PLAIN.format("text")} AS p FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT *, md5(p) AS key FROM t WHERE p <> ''),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, text_md5, lang NULLS FIRST, source NULLS FIRST) = 1),
b AS (SELECT {_PLAIN.format("text")} AS p FROM benchmark)"""

QUERIES = {"job1_training_shards": job1_training_shards, "job2_corpus_intake": job2_corpus_intake}

SQL = {}

SQL["job2_corpus_intake"] = f"""
WITH {_FIRST} SELECT doc_id, key, lang, source, text_md5, {_BUCKET.format("key", 8)} AS shard_id FROM f WHERE p NOT IN (SELECT p FROM b)
"""

SQL["job1_training_shards"] = f"""
WITH {_FIRST},
bw AS (SELECT DISTINCT array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT string_split(p, ' ') AS w FROM b) WHERE len(w) >= 10)),
dw AS (SELECT doc_id, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT doc_id, string_split(p, ' ') AS w FROM t) WHERE len(w) >= 10)),
o AS (SELECT DISTINCT doc_id FROM dw JOIN bw USING (run)),
v AS (SELECT *, p IN (SELECT p FROM b) OR doc_id IN (SELECT doc_id FROM o) AS overlap FROM f),
r AS (SELECT *, CASE WHEN overlap OR {_BUCKET.format("key || '7'", 100)} < 10 THEN 'val' ELSE 'train' END AS split FROM v),
l AS (SELECT doc_id, max(quality)::INTEGER AS quality, max(toxic)::INTEGER AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT * FROM r LEFT JOIN l USING (doc_id)),
y AS (SELECT 'quality/' || coalesce(lang, '') AS task, quality AS y FROM e WHERE split = 'train' UNION ALL SELECT 'toxic/' || coalesce(lang, ''), toxic FROM e WHERE split = 'train'),
g AS (SELECT task FROM y GROUP BY task HAVING count(*) FILTER (y = 1) >= 5 AND count(*) FILTER (y = 0) >= 1 AND count(*) FILTER (y IN (0, 1)) >= 8)
SELECT doc_id, key, lang, source, text_md5, overlap, split, CASE WHEN split = 'val' THEN {_BUCKET.format("key", 2)} ELSE {_BUCKET.format("key", 8)} END AS shard_id,
       CASE WHEN 'quality/' || coalesce(lang, '') IN (SELECT task FROM g) THEN quality END AS quality, CASE WHEN 'toxic/' || coalesce(lang, '') IN (SELECT task FROM g) THEN toxic END AS toxic
FROM e
"""
