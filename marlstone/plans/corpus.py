"""Queries over documents and labels: corpus preparation and label quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket, hash32, seeded_order
from ..operators import corpus as C
from ..operators import fallible, labels
from ..sources.tables import table
from .registry import query

H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
TOXIC = "SELECT DISTINCT d.text FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND d.text IS NOT NULL"


def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents keyed by k, the digest of their text: whole texts are read but never shuffled."""
    return table(spark, sf, "documents").select(F.md5("text").alias("k"), *columns)


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """Keys to exclude: those of documents labelled toxic, as a held-out set would be listed."""
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return C.key_set(_documents(spark, sf, "doc_id").join(toxic, "doc_id"), "k")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def dedup_exact(spark, sf):
    """WIN-01, FIL-01."""
    return C.keep_first(_documents(spark, sf, "doc_id", "lang", "source"), ["k"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""SELECT md5(text) AS k, arg_min(source, md5(doc_id::VARCHAR)) AS source, arg_min(quality, md5(doc_id::VARCHAR)) AS quality
FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY text""")
def dedup_argmin(spark, sf):
    """AGG-01, STR-01."""
    d = C.enrich(_documents(spark, sf, "doc_id", "source"), table(spark, sf, "labels", ["doc_id", "quality"]), "doc_id")
    return C.pick_columns(d, ["k"], ["source", "quality"], F.md5(F.col("doc_id").cast("string")))


@query("""SELECT md5(text) AS k, arg_min({'source': source, 'quality': quality}, md5(doc_id::VARCHAR)).source AS source, arg_min({'source': source, 'quality': quality}, md5(doc_id::VARCHAR)).quality AS quality
FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY text""")
def dedup_argmin_row(spark, sf):
    """AGG-01, row-consistent."""
    d = C.enrich(_documents(spark, sf, "doc_id", "source"), table(spark, sf, "labels", ["doc_id", "quality"]), "doc_id")
    return C.pick_rows(d, ["k"], ["source", "quality"], F.md5(F.col("doc_id").cast("string")))


@query(f"SELECT doc_id, lang FROM documents ANTI JOIN ({TOXIC}) USING (text)")
def decontaminate_drop(spark, sf):
    """JOI-01, SRC-03."""
    return C.drop_listed(_documents(spark, sf, "doc_id", "lang"), _listed(spark, sf), "k").select("doc_id", "lang")


@query(f"""WITH k AS ({TOXIC}), f AS (
  SELECT doc_id, text, text IN (SELECT text FROM k) OR {H.format("md5(text) || '7'")} % 100 < 29 AS is_val FROM documents)
SELECT doc_id, is_val, CASE WHEN is_val THEN 0 ELSE {H.format("md5(text)")} % 20 END::INTEGER AS shard_id FROM f""")
def decontaminate_route(spark, sf):
    """JOI-03, STR-02, T12, T25."""
    return C.route(_documents(spark, sf, "doc_id"), _listed(spark, sf), "k", 0.2999, 7, 20).select("doc_id", "is_val", "shard_id")


@query(f"SELECT lang, count(*)::BIGINT AS n FROM documents WHERE text IN (SELECT text FROM ({TOXIC})) GROUP BY lang")
def overlap_semi_count(spark, sf):
    """JOI-04."""
    return C.only_listed(_documents(spark, sf, "lang"), _listed(spark, sf), "k").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL")
def enrich_both_present(spark, sf):
    """JOI-02, FIL-02."""
    return C.enrich(table(spark, sf, "documents", ["doc_id", "lang"]), table(spark, sf, "labels"), "doc_id", ["quality", "lang"])


@query(f"SELECT ({H.format('o_orderkey::VARCHAR')} % 16)::INTEGER AS shard_id, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def shard_assign_counts(spark, sf):
    """PRJ-01, AGG-04."""
    return C.shard_counts(C.assign_shard(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 16))


@query(f"""SELECT o_orderkey, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey)::BIGINT AS place
FROM (SELECT o_orderkey, ({H.format('o_orderkey::VARCHAR')} % 16)::INTEGER AS shard_id FROM orders)""")
def seeded_shuffle_rank(spark, sf):
    """SRT-01, SRT-08."""
    from pyspark.sql import Window as W

    o = C.assign_shard(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 16)
    w = W.partitionBy("shard_id").orderBy(seeded_order("o_orderkey", 42), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w).cast("long"))


@query(f"""SELECT count(*)::BIGINT AS n_rows, count(text)::BIGINT AS n_text, count(*) FILTER (WHERE quality IS NOT NULL)::BIGINT AS n_labelled,
  count(*) FILTER (WHERE text IN (SELECT text FROM ({TOXIC})))::BIGINT AS n_listed, count(DISTINCT text)::BIGINT AS n_distinct, count(DISTINCT source)::BIGINT AS n_sources
FROM documents LEFT JOIN labels USING (doc_id)""")
def prep_manifest(spark, sf):
    """AGG-02, AGG-03."""
    d = C.enrich(_documents(spark, sf, "doc_id", "source"), table(spark, sf, "labels", ["doc_id", "quality"]), "doc_id")
    d = C.flag_listed(d, _listed(spark, sf), "k")
    conditions = {"n_text": F.col("k").isNotNull(), "n_labelled": F.col("quality").isNotNull(), "n_listed": F.col("listed")}
    return C.counts(d, conditions, {"n_distinct": "k", "n_sources": "source"})


@query(f"""WITH k AS ({TOXIC}), d AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text),
r AS (SELECT doc_id, text IN (SELECT text FROM k) OR {H.format("md5(text) || '7'")} % 100 < 10 AS is_val, ({H.format("md5(text)")} % 8)::INTEGER AS s FROM d)
SELECT is_val, CASE WHEN is_val THEN 0 ELSE s END AS shard_id, count(*)::BIGINT AS n, count(quality)::BIGINT AS n_labelled,
  coalesce(avg(quality), 0.0)::DOUBLE AS good FROM r LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def corpus_preparation(spark, sf):
    """WIN-01, JOI-02, JOI-03, PRJ-01, AGG-04, AGG-05: the whole preparation."""
    d = C.keep_first(_documents(spark, sf, "doc_id"), ["k"], ["doc_id"])
    r = C.route(d, _listed(spark, sf), "k", 0.1, 7, 8)
    e = C.enrich(r.select("doc_id", "is_val", "shard_id"), table(spark, sf, "labels", ["doc_id", "quality"]), "doc_id")
    return e.groupBy("is_val", "shard_id").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("good"))


_STATS = """SELECT task, n_pos + n_neg AS n_valid, n_pos, n_neg, n - n_pos - n_neg AS n_nan, CASE WHEN n_pos + n_neg = 0 THEN 0.0::DOUBLE ELSE n_pos::DOUBLE / (n_pos + n_neg) END AS pos_frac FROM (
  SELECT task, count(*)::BIGINT AS n, count(*) FILTER (WHERE y = 1)::BIGINT AS n_pos, count(*) FILTER (WHERE y = 0)::BIGINT AS n_neg FROM (
    SELECT 'quality' AS task, quality AS y FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY task)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return C.enrich(table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"]), table(spark, sf, "labels"), "doc_id")


@query(_STATS)
def label_qc_wide(spark, sf):
    """AGG-05."""
    return labels.task_stats_wide(_labelled(spark, sf), ["quality", "toxic"])


@query(_STATS)
def label_qc_melt(spark, sf):
    """AGG-05, melted."""
    return labels.task_stats(labels.melt(_labelled(spark, sf), ["doc_id"], ["quality", "toxic"]))


_ASSAYS = """a AS (SELECT lang || '/' || source AS task, count(*) FILTER (WHERE quality = 1)::BIGINT AS n_pos, count(*) FILTER (WHERE quality = 0)::BIGINT AS n_neg, count(quality)::BIGINT AS n_valid
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
f AS (SELECT *, nullif(concat_ws(';', CASE WHEN n_pos < 5 THEN 'n_pos=' || n_pos || '<5' END, CASE WHEN n_neg < 1 THEN 'n_neg=' || n_neg || '<1' END, CASE WHEN n_valid < 8 THEN 'n_valid=' || n_valid || '<8' END), '') AS drop_reason FROM a)"""


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    long = _labelled(spark, sf).select(F.concat_ws("/", "lang", "source").alias("task"), F.col("quality").alias("y"))
    return labels.filter_tasks(labels.task_stats(long), 5, 1, 8)


@query(f"WITH {_ASSAYS} SELECT task, n_valid, n_pos, n_neg, drop_reason, drop_reason IS NULL AS kept FROM f")
def label_filter_reasons(spark, sf):
    """FIL-05."""
    return _filtered(spark, sf).select("task", "n_valid", "n_pos", "n_neg", "drop_reason", "kept")


@query(f"WITH {_ASSAYS} SELECT split_part(r, '=', 1) AS reason, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(drop_reason, ';')) AS r FROM f WHERE drop_reason IS NOT NULL) GROUP BY 1")
def label_reason_histogram(spark, sf):
    """AGG-09."""
    return labels.reason_histogram(_filtered(spark, sf))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT l_returnflag, min(v) AS least, max(v) FILTER (WHERE i = floor(0.25::DOUBLE * (n - 1))) AS q25, max(v) FILTER (WHERE i = floor(0.5::DOUBLE * (n - 1))) AS q50, max(v) FILTER (WHERE i = floor(0.9::DOUBLE * (n - 1))) AS q90, max(v) AS most FROM r GROUP BY l_returnflag""")
def quantile_floor(spark, sf):
    """AGG-08, T9."""
    return labels.floor_quantiles(table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"]), "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.9])


@query("""WITH d AS (SELECT lang || '/' || CASE WHEN doc_id % 11 = 0 THEN 'few' WHEN doc_id % 3 = 0 THEN 'some' ELSE 'many' END AS task, toxic AS y FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'lines', (l_linenumber % 3)::INTEGER FROM lineitem UNION ALL SELECT 'no zero', (o_orderkey % 2 + 1)::INTEGER FROM orders WHERE o_orderkey < 900),
c AS (SELECT task, y, count(*)::BIGINT AS c FROM d GROUP BY ALL), t AS (SELECT task, sum(c)::BIGINT AS n, max(y) AS top, count(*) AS k, min(c) AS low FROM c GROUP BY task),
m AS (SELECT task, n, CASE WHEN k > top THEN low ELSE 0 END::BIGINT AS min_class FROM t)
SELECT task, n, min_class, greatest(2, least(CASE WHEN n > 2000 THEN 3 WHEN n >= 250 THEN 5 ELSE 3 END, min_class))::BIGINT AS folds FROM m""")
def min_class_folds(spark, sf):
    """AGG-24: tasks of all three sizes, rare classes and one without a class 0."""
    part = F.when(F.col("doc_id") % 11 == 0, "few").when(F.col("doc_id") % 3 == 0, "some").otherwise("many")
    docs = table(spark, sf, "documents", ["doc_id", "lang"]).join(table(spark, sf, "labels"), "doc_id").select(F.concat("lang", F.lit("/"), part).alias("task"), F.col("toxic").cast("int").alias("y"))
    lines = table(spark, sf, "lineitem", ["l_linenumber"]).select(F.lit("lines").alias("task"), (F.col("l_linenumber") % 3).cast("int").alias("y"))
    odd = table(spark, sf, "orders", ["o_orderkey"]).where("o_orderkey < 900").select(F.lit("no zero").alias("task"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("y"))
    return labels.adaptive_folds(docs.union(lines).union(odd), "task", "y")


@query("SELECT count(quality)::BIGINT AS quality, count(toxic)::BIGINT AS toxic, count(lang)::BIGINT AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def endpoint_counts(spark, sf):
    """AGG-33."""
    return labels.valid_counts(_labelled(spark, sf), ["quality", "toxic", "lang"])


@query("""SELECT (SELECT count(*) FROM (SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier))::BIGINT AS n_union,
  (SELECT count(*) FROM (SELECT p_partkey FROM part INTERSECT SELECT s_suppkey FROM supplier))::BIGINT AS n_both""")
def key_set_union_intersect(spark, sf):
    """SET-01, SET-06, SET-07: both from one full join of distinct keys."""
    a, b = C.key_set(table(spark, sf, "part"), "p_partkey").withColumn("a", F.lit(1)), C.key_set(table(spark, sf, "supplier"), "s_suppkey").withColumn("b", F.lit(1))
    return a.join(b, "key", "full").agg(F.count("*").alias("n_union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


@query("""WITH u AS (SELECT 0 AS part, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 1, o_orderkey, o_orderstatus, o_totalprice * 2 FROM orders WHERE o_orderstatus <> 'O')
SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY part, o_orderstatus, o_totalprice) AS rn FROM u) WHERE rn = 1""")
def merge_shards_keep_first(spark, sf):
    """SET-02."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return C.merge_keep_first([o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'").withColumn("o_totalprice", F.col("o_totalprice") * 2)], ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def remaining_keys(spark, sf):
    """SET-03, FIL-17."""
    done = table(spark, sf, "lineitem", ["l_orderkey", "l_linestatus"]).where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.remaining(table(spark, sf, "orders", ["o_orderkey"]), done, ["o_orderkey"])


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, 'X', o_totalprice * 2 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def keyed_upsert(spark, sf):
    """JOI-12, SNK-13."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    new = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return C.upsert(o.drop("o_orderpriority"), new, ["o_orderkey"])


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, l.quality IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_with_default(spark, sf):
    """JOI-06, JOI-07."""
    return C.lookup(table(spark, sf, "documents", ["doc_id"]), table(spark, sf, "labels"), "doc_id", "quality", F.lit(-1)).select("doc_id", "quality", "found")


@query("SELECT d.doc_id, coalesce(l.quality, m.q, 0)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, max(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY source) m USING (source)")
def fallback_chain(spark, sf):
    """JOI-05, JOI-13: own label, else the best of the source, else 0."""
    own = C.enrich(table(spark, sf, "documents", ["doc_id", "source"]), table(spark, sf, "labels", ["doc_id", "quality"]), "doc_id")
    best = own.groupBy("source").agg(F.max("quality").alias("quality"))
    return C.first_present(own, best, "source", "quality").select("doc_id", F.coalesce("quality", F.lit(0)).cast("long").alias("quality"))


@query("""SELECT task, method, coalesce(b.mean, a.mean) AS mean, CASE WHEN b.task IS NOT NULL THEN b.std ELSE a.std END AS std FROM
  (SELECT p_brand AS task, p_type AS method, min(p_retailprice) AS mean, NULL::DOUBLE AS std FROM part GROUP BY 1, 2) a
  FULL JOIN (SELECT p_brand AS task, p_type AS method, max(p_retailprice) AS mean, count(*)::DOUBLE AS std FROM part WHERE p_size > 25 GROUP BY 1, 2) b USING (task, method)""")
def leaderboard_merge(spark, sf):
    """JOI-11, MAP-01, SRC-17."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("task"), F.col("p_type").alias("method"), "p_retailprice", "p_size")
    base = p.groupBy("task", "method").agg(F.min("p_retailprice").alias("mean")).withColumn("std", F.lit(None).cast("double"))
    over = p.where("p_size > 25").groupBy("task", "method").agg(F.max("p_retailprice").alias("mean"), F.count("*").cast("double").alias("std"))
    return C.overriding_merge(base, over, ["task", "method"], ["mean", "std"])


def _key_number(props: str) -> int:
    import json

    n = json.loads(props)["k"]
    if n % 7 == 3:
        raise ValueError("a seventh fails")
    return n * 2


@query("""SELECT event_id, CASE WHEN k % 7 <> 3 THEN 2 * k END AS value, CASE WHEN k % 7 = 3 THEN 'ValueError: a seventh fails' END AS error
FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)""")
def fallible_map(spark, sf):
    """UDF-01, UDF-02, UDF-04, UDF-05."""
    return fallible.fallible_map(table(spark, sf, "events", ["event_id", "props"]), "props", _key_number, "bigint", seconds=10).select("event_id", "value", "error")


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, (i - 1)::INTEGER AS pos, array_to_string(w[i:i + 4], ' ') AS ngram FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)""")
def udtf_expand(spark, sf):
    """UDT-01."""
    return fallible.expand_ngrams(table(spark, sf, "benchmark"), "item_id", "text", 5)


@query(f"SELECT c_custkey, ({H.format('c_name')} % 10)::INTEGER AS b, {H.format('c_name')} AS h FROM customer")
def portable_hash(spark, sf):
    """STR-02, T1."""
    return table(spark, sf, "customer").select("c_custkey", bucket(10, "c_name").alias("b"), hash32("c_name").alias("h"))
