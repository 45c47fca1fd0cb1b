"""Queries that write and read back: scans, sinks, caches, registries, claims and running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, numeric
from ..operators import compare as K
from ..operators import corpus as C
from ..operators import fallible, features, heads
from ..operators import labels as label_ops
from ..operators import metrics as M
from ..operators import ragged
from ..session import scratch_folder
from ..sources import arrays, files, sinks, tables
from ..sources.tables import table
from ..streaming import incremental as S
from .registry import query

_MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


# ----------------------------------------------------------------- scans
@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey")
def scan_view(spark, sf):
    """SRC-01, SRC-04: a view over a glob, queried in SQL."""
    tables.view(spark, f"{sf}/natio*.parquet", "marlstone_nation")
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM marlstone_nation GROUP BY n_regionkey")


@query("SELECT l_returnflag AS folder, l_linestatus AS inner_folder, count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ALL")
def discover_nested(spark, sf):
    """SRC-02: files of nested folders, whatever the folders are called."""
    to = scratch_folder(spark)
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"])
    li.withColumns({"folder": F.col("l_returnflag"), "inner_folder": F.col("l_linestatus")}).write.partitionBy("folder", "inner_folder").parquet(to)
    found = tables.discover(spark, to)
    return found.groupBy(F.col("l_returnflag").alias("folder"), F.col("l_linestatus").alias("inner_folder")).agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("SELECT 'label::' || k AS label, count(v)::BIGINT AS n, sum(v)::BIGINT AS positives FROM (UNPIVOT (SELECT doc_id, quality, toxic FROM labels) ON quality, toxic INTO NAME k VALUE v) GROUP BY k")
def label_columns(spark, sf):
    """SRC-05, SRC-21: label columns found by their prefix in the schema of a written table."""
    to = scratch_folder(spark)
    table(spark, sf, "labels").withColumnsRenamed({"quality": "label::quality", "toxic": "label::toxic"}).write.parquet(to)
    df = spark.read.parquet(to)
    names = tables.label_columns(df, "label::")
    aggs = [F.struct(F.lit(c).alias("label"), F.count(F.col(f"`{c}`")).alias("n"), F.sum(F.col(f"`{c}`")).alias("positives")) for c in names]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


@query("SELECT n_name, n_regionkey, (SELECT count(*) FROM nation)::BIGINT AS n FROM nation")
def required_columns(spark, sf):
    """SRC-06, PRJ-05, PRJ-06: exactly the named columns, beside the number of rows in the footers."""
    df = table(spark, sf, "nation")
    rows = files.file_names(df).agg(F.sum("n").alias("n"))
    return tables.require(df, ["n_name", "n_regionkey"]).crossJoin(F.broadcast(rows))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def json_lines(spark, sf):
    """SRC-08: JSON lines with a given schema."""
    to = scratch_folder(spark)
    df = table(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    df.write.json(to)
    return tables.json_lines(spark, to, df.schema)


@query("SELECT endpoint, count(value)::BIGINT AS n, round(sum(value), 2) AS total FROM (UNPIVOT (SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS buyer FROM orders) ON price, buyer INTO NAME endpoint VALUE value) GROUP BY endpoint")
def csv_endpoints(spark, sf):
    """SRC-12, SRC-13, AGG-33: a CSV table whose other columns are all endpoints."""
    to = scratch_folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("double")).alias("buyer"))
    o.write.option("header", True).csv(to)
    df = tables.csv(spark, to)
    ends = [c for c in df.columns if c != "o_orderkey"]
    long = df.unpivot(["o_orderkey"], [F.col(c).cast("double").alias(c) for c in ends], "endpoint", "value")
    return long.groupBy("endpoint").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT split, list_sort(list(DISTINCT lang)) AS keys FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang FROM documents) GROUP BY split")
def keys_by_split(spark, sf):
    """SRC-10, SRC-11, SET-06: union of splits, read with retry; sorted distinct keys of each."""
    failed = []

    def read() -> DataFrame:
        if not failed:
            failed.append(1)
            raise OSError("the first try fails")
        return table(spark, sf, "documents", ["doc_id", "lang"])

    d = tables.with_retry(read, wait=0.01)
    both = tables.union_of_splits({"train": d.where("doc_id % 5 <> 0"), "test": d.where("doc_id % 5 = 0")})
    return tables.keys_by(both, "split", "lang")


@query("SELECT DISTINCT c_mktsegment AS key FROM customer")
def key_lines(spark, sf):
    """SRC-22: a line-delimited key file, blank lines left out."""
    to = scratch_folder(spark)
    seg = table(spark, sf, "customer", ["c_mktsegment"]).distinct()
    seg.select(F.concat(F.lit(" "), "c_mktsegment", F.lit("\n")).alias("value")).write.text(to)
    return tables.keys_file(spark, to)


@query("SELECT p_brand AS key, list_sort(list(p_partkey || chr(10) || p_name)) AS records FROM part GROUP BY p_brand")
def grouped_text_records(spark, sf):
    """SRC-14, JOI-18: records between separator lines, by the key in their first line."""
    to = scratch_folder(spark)
    table(spark, sf, "part", ["p_partkey", "p_name", "p_brand"]).select(F.concat_ws("\n", "p_brand", "p_partkey", "p_name", F.lit("$$$$")).alias("value")).write.text(to)
    got = tables.text_records(spark, to, "$$$$")
    body = F.substring_index("record", "\n", -2)
    return tables.grouped_records(got.select(F.substring_index("record", "\n", 1).alias("k"), body.alias("record")), F.col("k"))


@query("SELECT label::VARCHAR AS shard, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, round(embedding[1]::DOUBLE, 7) AS first_value, len(embedding)::BIGINT AS width FROM embeddings")
def array_shards(spark, sf):
    """SRC-19, SNK-05, SNK-09, SET-08: one array file a shard, rows appended in order, all read again."""
    to = scratch_folder(spark)
    e = table(spark, sf, "embeddings", ["vec_id", "label", "embedding"]).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    files.write_array_files(e, to, "label", "vec_id", "embedding").write.parquet(f"{to}-made")
    spark.read.parquet(f"{to}-made").createOrReplaceTempView("marlstone_made")
    got = tables.array_files(spark, f"{to}/*.npy")
    return got.select(F.split("file", "-")[0].alias("shard"), F.col("row").alias("pos"), F.round(F.get("values", F.lit(0)), 7).alias("first_value"), F.size("values").cast("long").alias("width"))


@query("""WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding FROM embeddings)
SELECT label::VARCHAR AS shard, i AS row, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM r WHERE i BETWEEN 3 AND 40""")
def array_row_ranges(spark, sf):
    """SRC-19, SNK-09: rows 3 to 40 of each array file: tasks read row ranges by offset, here of eight rows."""
    to = scratch_folder(spark)
    e = table(spark, sf, "embeddings", ["vec_id", "label", "embedding"]).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    files.write_array_files(e, to, "label", "vec_id", "embedding").write.parquet(f"{to}-made")
    got = arrays.array_rows(spark, f"{to}/*.npy", partition_bytes=8 * 64 * 8).where("row >= 3 and row <= 40")
    return got.select(F.split("file", "-")[0].alias("shard"), "row", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH p AS (SELECT p_type AS smiles, p_name AS title, p_partkey AS id, p_retailprice AS energy FROM part)
SELECT smiles, count(*)::BIGINT AS n, arg_min(title, struct_pack(energy, id)) AS best, min(energy) AS energy FROM p GROUP BY smiles""")
def structure_files(spark, sf):
    """SRC-14, JOI-18, SRT-05: structure records with properties from large text files, grouped by one property, the least by another."""
    to = scratch_folder(spark)
    lines = F.concat_ws("\n", "p_name", F.lit("  0  0"), F.lit("M  END"), F.lit("> <SMILES>"), "p_type", F.lit(""), F.lit(">  <ENERGY>"), F.col("p_retailprice").cast("string"), F.lit(""), F.lit("> <ID>"), "p_partkey", F.lit(""), F.lit("$$$$"))
    table(spark, sf, "part").select(lines.alias("value")).coalesce(1).write.text(to)
    got = tables.structure_records(spark, to)
    p = got.select(F.col("properties")["SMILES"].alias("smiles"), "title", F.col("properties")["ID"].cast("long").alias("id"), F.col("properties")["ENERGY"].cast("double").alias("energy"))
    best = p.groupBy("smiles").agg(F.count("*").alias("n"), F.min(F.struct("energy", "id", "title")).alias("b"))
    return best.select("smiles", "n", F.col("b.title").alias("best"), F.col("b.energy").alias("energy"))


@query("""SELECT method, '1' AS seed, task, 'mean' AS metric, round(avg(l_discount), 6) AS value FROM (SELECT l_returnflag AS method, l_shipmode AS task, l_discount FROM (SELECT l_returnflag, l_linestatus AS l_shipmode, l_discount FROM lineitem)) WHERE method <> 'R' GROUP BY ALL""")
def result_folder(spark, sf):
    """SRC-16, SRC-24: result files of a folder; a corrupt one and one with a leading underscore give nothing, an absent folder neither."""
    to = scratch_folder(spark)
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_discount"])
    facts = li.groupBy(F.col("l_returnflag").alias("method"), F.lit("1").alias("seed"), F.col("l_linestatus").alias("task"), F.lit("mean").alias("metric")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    for r in tables.cube_json(facts, ["method"]).collect():  # one text a method
        sinks.write_markdown(spark, f"{to}/{r.method}.json", "{not json" if r.method == "R" else r.json)
    sinks.write_markdown(spark, f"{to}/_summary.json", '{"1": {"x": {"mean": 1.0}}}')
    return tables.result_files(spark, to).union(tables.result_files(spark, f"{to}-absent"))


@query("SELECT part, key, n::BIGINT AS n FROM (SELECT 'first wins' AS part, c_nationkey AS key, max(c_acctbal::BIGINT) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL) WHERE false UNION ALL "
       "SELECT 'first wins', k, min(v) FROM (SELECT c_nationkey AS k, min(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY c_nationkey) AS part, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS own, c_custkey AS v FROM customer) WHERE own = part GROUP BY k "
       "UNION ALL SELECT 'cleared', c_nationkey, min(c_custkey) FROM customer WHERE c_custkey % 2 = 1 GROUP BY c_nationkey")
def cache_tables(spark, sf):
    """SRC-15, SRC-23: two cache tables read one after another, keeping the first or clearing."""
    to = scratch_folder(spark)
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey"]).select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("n"))
    parts = []
    for k in (0, 1):
        c.where(F.col("n") % 2 == k).write.parquet(f"{to}/{k}")
        parts.append(spark.read.parquet(f"{to}/{k}"))
    one = lambda part, clear: tables.keyed_cache(parts, "key", clear).select(F.lit(part).alias("part"), "key", "n")
    return one("first wins", False).union(one("cleared", True))


# ----------------------------------------------------------------- sinks
@query(f"SELECT shard_id, o_orderkey, row_number() OVER (PARTITION BY shard_id ORDER BY md5(o_orderkey::VARCHAR || '7'), o_orderkey) - 1 AS place FROM (SELECT o_orderkey, ({_MD5.format('o_orderkey::VARCHAR')} % 5)::INTEGER AS shard_id FROM orders)")
def shard_files(spark, sf):
    """SNK-01: one file a shard, rows in seeded order in the file."""
    to = scratch_folder(spark)
    sinks.write_shards(C.assign_shard(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 5), to, "o_orderkey", seed=7)
    return spark.read.parquet(to).select("shard_id", "o_orderkey", F.col("_metadata.row_index").alias("place"))


@query(f"SELECT is_val, shard_id, o_orderkey, row_number() OVER (PARTITION BY is_val, shard_id ORDER BY o_orderkey) - 1 AS place FROM (SELECT o_orderkey, o_orderkey % 10 = 0 AS is_val, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE ({_MD5.format('o_orderkey::VARCHAR')} % 3)::INTEGER END AS shard_id FROM orders)")
def split_files(spark, sf):
    """SNK-02, SRT-02: validation and training shards, rows in order of key."""
    to = scratch_folder(spark)
    o = table(spark, sf, "orders", ["o_orderkey"]).withColumn("is_val", F.col("o_orderkey") % 10 == 0)
    sinks.write_split(o.withColumn("shard_id", F.when(F.col("is_val"), 0).otherwise(keys.bucket(3, "o_orderkey"))), to, "o_orderkey")
    return spark.read.parquet(to).select(F.col("is_val").cast("boolean").alias("is_val"), "shard_id", "o_orderkey", F.col("_metadata.row_index").alias("place"))


@query("SELECT o_orderkey, o_totalprice, true AS few FROM orders")
def merged_shards(spark, sf):
    """SNK-08, SNK-11, SET-08: shards consolidated into at most two files."""
    to = scratch_folder(spark)
    C.assign_shard(table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 6).write.partitionBy("shard_id").parquet(to)
    sinks.merge_shards(spark, [f"{to}/shard_id={k}" for k in range(6)], f"{to}-merged", 2)
    out = spark.read.parquet(f"{to}-merged")
    n = files.file_names(out).agg((F.count("*") <= 2).alias("few"))
    return out.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(n))


@query("SELECT sum(n)::BIGINT AS n, bool_and(n <= 1000) AS small FROM (SELECT least(1000, count(*) - 1000 * i) AS n FROM orders, range(0, 1000) r(i) GROUP BY i HAVING count(*) > 1000 * i)")
def rows_per_file(spark, sf):
    """SNK-12: no file has more rows than asked for."""
    to = scratch_folder(spark)
    sinks.write_rows_per_file(table(spark, sf, "orders", ["o_orderkey"]), to, 1000)
    return files.file_names(spark.read.parquet(to)).agg(F.sum("n").alias("n"), F.expr("bool_and(n <= 1000)").alias("small"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM orders")
def upserted_table(spark, sf):
    """SNK-10, SNK-13, FIL-17: a keyed table written, then partly replaced twice."""
    to = scratch_folder(spark)
    o = table(spark, sf, "orders", ["o_orderkey"])
    for version, rows in ((1, o.where("o_orderkey % 2 = 1")), (2, o.where("o_orderkey % 2 = 0")), (3, o.where("o_orderkey % 7 = 0"))):
        sinks.upsert_parquet(spark, to, rows.withColumn("version", F.lit(version)), ["o_orderkey"])
    return sinks.read_upserted(spark, to)


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT count(*)::BIGINT AS n_rows, count(text)::BIGINT AS n_text, count(quality)::BIGINT AS n_labelled, count(DISTINCT md5(text))::BIGINT AS n_distinct, 7::BIGINT AS seed, [0.1::DOUBLE, 0.9::DOUBLE] AS fractions FROM documents LEFT JOIN l USING (doc_id)""")
def manifest_file(spark, sf):
    """SNK-03, AGG-02, AGG-03: statistics of a preparation and its parameters written as a JSON manifest, and read again."""
    to = scratch_folder(spark)
    d = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.md5("text").alias("k"))
    own = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    row = C.counts(C.enrich(d, own, "doc_id"), {"n_text": F.col("k").isNotNull(), "n_labelled": F.col("quality").isNotNull()}, {"n_distinct": "k"})
    sinks.write_manifest(row, f"{to}/manifest.json", seed=7, fractions=[0.1, 0.9])
    return spark.read.option("multiLine", True).json(f"{to}/manifest.json")


@query("""WITH a AS (SELECT lang || '/' || source AS task, count(*) FILTER (quality = 1)::BIGINT AS n_pos, count(*) FILTER (quality = 0)::BIGINT AS n_neg, count(quality)::BIGINT AS n_valid FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
f AS (SELECT *, nullif(concat_ws(';', CASE WHEN n_pos < 5 THEN 'n_pos=' || n_pos || '<5' END, CASE WHEN n_neg < 1 THEN 'n_neg=' || n_neg || '<1' END, CASE WHEN n_valid < 8 THEN 'n_valid=' || n_valid || '<8' END), '') AS drop_reason FROM a)
SELECT (row_number() OVER (ORDER BY task) - 1)::INTEGER AS place, task, n_valid, n_pos, n_neg, drop_reason, drop_reason IS NULL AS kept FROM f""")
def label_qc_file(spark, sf):
    """SNK-04, FIL-05, SRT-03: the quality control of all labels as one JSON list in order of task, each entry with kept, read again by place."""
    to = scratch_folder(spark)
    d = C.enrich(table(spark, sf, "documents", ["doc_id", "lang", "source"]), table(spark, sf, "labels"), "doc_id")
    long = d.select(F.concat_ws("/", "lang", "source").alias("task"), F.col("quality").alias("y"))
    out = label_ops.filter_tasks(label_ops.task_stats(long), 5, 1, 8).select("task", "n_valid", "n_pos", "n_neg", "drop_reason", "kept")
    sinks.write_json_sorted(out, f"{to}/stats.json", "task")
    text = spark.read.text(f"{to}/stats.json", wholetext=True)
    listed = text.select(F.from_json("value", f"array<{out.schema.simpleString()}>").alias("a"))
    return listed.select(F.posexplode("a").alias("place", "r")).select("place", "r.*")


@query("""WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
SELECT CASE WHEN k % 7 = 3 THEN 'bad' ELSE 'good' END AS folder, count(*)::BIGINT AS n, coalesce(sum(CASE WHEN k % 7 <> 3 THEN 2 * k END), 0)::BIGINT AS total, CASE WHEN k % 7 = 3 THEN 'ValueError: a seventh fails' END AS error FROM e GROUP BY ALL""")
def quarantine_files(spark, sf):
    """SNK-06, UDF-01: rows whose conversion failed are written apart, with the reason; both folders read again."""
    to = scratch_folder(spark)

    def convert(props: str) -> int:
        import json

        if (n := json.loads(props)["k"]) % 7 == 3:
            raise ValueError("a seventh fails")
        return n * 2

    rows = fallible.fallible_map(table(spark, sf, "events", ["event_id", "props"]), "props", convert, "bigint", seconds=10)
    sinks.write_with_quarantine(rows, f"{to}/good", f"{to}/bad")
    good, bad = spark.read.parquet(f"{to}/good").select(F.lit("good").alias("folder"), "value", F.lit(None).cast("string").alias("error")), spark.read.parquet(f"{to}/bad").select(F.lit("bad").alias("folder"), "value", "error")
    return good.union(bad).groupBy("folder", "error").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total"))


@query("""WITH c AS (SELECT p_brand AS b, p_size % 3 AS s, printf('%.2f', round(avg(p_retailprice), 2)) AS v FROM part WHERE p_size % 3 <> 1 OR p_brand <> 'Brand#12' GROUP BY ALL),
w AS (SELECT b, coalesce(max(v) FILTER (s = 0), '-') AS x, coalesce(max(v) FILTER (s = 1), '-') AS y, coalesce(max(v) FILTER (s = 2), '-') AS z FROM c GROUP BY b)
SELECT 0::BIGINT AS place, '| brand | 0 | 1 | 2 |' AS line UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY b) + 1, '| ' || b || ' | ' || x || ' | ' || y || ' | ' || z || ' |' FROM w""")
def markdown_file(spark, sf):
    """SNK-14, STR-08: a table of results by row and column as a Markdown file, gaps as '-', read again line by line."""
    to = scratch_folder(spark)
    part = table(spark, sf, "part", ["p_brand", "p_size", "p_retailprice"]).withColumn("s", F.col("p_size") % 3).where("s <> 1 or p_brand <> 'Brand#12'")
    cells = part.groupBy(F.col("p_brand").alias("brand"), "s").agg(F.format_string("%.2f", F.round(F.avg("p_retailprice"), 2)).alias("v"))
    sinks.write_markdown(spark, f"{to}/table.md", K.markdown(cells, "brand", "s", "v"))
    lines = spark.read.text(f"{to}/table.md", wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\s+$", ""), "\n")).alias("place", "line"))
    return lines.select(F.col("place").cast("long").alias("place"), "line")


_LOSS_OF = "CASE hash WHEN 0 THEN 'huber' WHEN 1 THEN 'log_huber' WHEN 2 THEN 'beta_nll' WHEN 3 THEN 'ordinal' ELSE 'focal' END"
_REGISTRY = f"""t AS (SELECT DISTINCT 'x_' || p_size || '_' || p_brand || '_' AS task, p_size % 5 AS hash FROM part),
r AS (SELECT task, {_LOSS_OF} AS loss FROM t), l AS (SELECT * FROM (VALUES ('huber', 'mae', 1, false), ('log_huber', 'mae', 1, false), ('log_ratio_squared', 'mae', 1, false), ('beta_nll', 'mae', 2, false), ('ordinal', 'acc', 1, true), ('focal', 'auroc', 1, true)) v(loss, metric, n_outputs, higher_is_better)),
g AS (SELECT task, loss, metric, n_outputs, higher_is_better FROM r JOIN l USING (loss) WHERE loss <> 'log_huber' AND NOT contains(task, '_13_') AND NOT contains(task, '_Brand#21_'))"""


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of all sizes of all brands, each with a loss by its size."""
    part = table(spark, sf, "part", ["p_size", "p_brand"])
    loss = F.element_at(F.array(*[F.lit(x) for x in ("huber", "log_huber", "beta_nll", "ordinal", "focal")]), F.col("p_size") % 5 + 1)
    tasks = part.select(F.concat(F.lit("x_"), "p_size", F.lit("_"), "p_brand", F.lit("_")).alias("task"), loss.alias("loss")).distinct()
    return features.register(tasks, ("log_huber",), ("13", "Brand#21"))


@query(f"""WITH {_REGISTRY}, a AS (SELECT DISTINCT p_type AS assay FROM part) SELECT task, loss, metric, n_outputs, higher_is_better, NULL::INTEGER AS assay_idx FROM g
UNION ALL SELECT 'bio/' || assay, 'focal', 'auroc', 1, true, (row_number() OVER (ORDER BY assay) - 1)::INTEGER FROM a""")
def task_table(spark, sf):
    """EXT-01, EXT-05, FIL-09: a registry from a table of tasks, without an excluded loss and excluded infixes, and a source expanded to its assays."""
    return features.expand_assays(_registry(spark, sf), table(spark, sf, "part", ["p_type"]), "bio", "p_type")


@query(f"WITH {_REGISTRY} SELECT higher_is_better, n_outputs, list_sort(list(task)) AS tasks FROM g GROUP BY ALL")
def task_table_by_size(spark, sf):
    """AGG-32: the registered tasks of each direction and number of outputs."""
    return features.outputs_by_size(_registry(spark, sf))


@query("SELECT event_type, round(sum(value), 4) AS total, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def metric_log(spark, sf):
    """SNK-16: batches of a stream logged by number; one is sent twice and counts once."""
    to = scratch_folder(spark)

    def log(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            sinks.log_metrics(batch.groupBy("event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n")), batch_id, to)

    S.file_stream(spark, f"{sf}/events.parquet").writeStream.foreachBatch(log).option("checkpointLocation", f"{to}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to).groupBy("event_type").agg(F.round(F.sum("total"), 4).alias("total"), F.sum("n").alias("n"))


@query("SELECT kind, item FROM (SELECT 'mine' AS kind, 'shard-' || n_nationkey AS item FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 UNION ALL SELECT 'other', 'shard-' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 5 <> 0)")
def work_claims(spark, sf):
    """STM-04: of the shards one worker claims every third, another gets the rest; finished ones are nobody's."""
    to = scratch_folder(spark)
    items = [(r.n_nationkey, f"shard-{r.n_nationkey}") for r in table(spark, sf, "nation", ["n_nationkey"]).collect()]  # a work list
    for k, x in items:
        if k % 5 == 0:
            sinks.write_markdown(spark, f"{to}/done/{x}", "done")
    other = files.claim(spark, f"{to}/locks", [x for k, x in items if k % 3 == 0], f"{to}/done")
    mine = files.claim(spark, f"{to}/locks", [x for _, x in items], f"{to}/done")
    return spark.createDataFrame([("mine", x) for x in mine] + [("other", x) for x in other], "kind string, item string")


# ----------------------------------------------------------------- projections, filters, lookups
@query("SELECT l_orderkey, l_linenumber, l_discount::FLOAT AS l_discount, l_tax::FLOAT AS l_tax FROM lineitem")
def float_labels(spark, sf):
    """PRJ-04: label columns found by name become single precision."""
    df = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    return tables.as_floats(df, [c for c in df.columns if c in ("l_discount", "l_tax")])


_TASKS = {"t_mae": "huber", "q_log_x": "log_huber", "q_skip_y": "huber", "cls": "focal", "ord": "ordinal", "dist": "beta_nll"}


@query("SELECT * FROM (VALUES ('t_mae', 'huber', 'mae', 1, false, NULL), ('cls', 'focal', 'auroc', 1, true, NULL), ('dist', 'beta_nll', 'mae', 2, false, NULL), ('ord', 'ordinal', 'acc', 1, true, NULL), "
       "('bio/a1', 'focal', 'auroc', 1, true, 0), ('bio/a2', 'focal', 'auroc', 1, true, 1)) AS t(task, loss, metric, n_outputs, higher_is_better, assay_idx)")
def registered_tasks(spark, sf):
    """EXT-01, EXT-05, FIL-09: the registry without excluded losses and infixes, a source expanded to its assays."""
    reg = features.task_registry(spark, _TASKS, exclude_losses=("log_huber",), exclude_infixes=("skip",))
    return features.group_assays(reg, "bio", ["a1", "a2"], expand=True)


@query("SELECT * FROM (VALUES (false, 1, ['q_log_x', 'q_skip_y', 't_mae']), (false, 2, ['dist']), (true, 1, ['cls', 'ord'])) AS t(higher_is_better, n_outputs, tasks)")
def outputs_by_size(spark, sf):
    """AGG-32."""
    return features.outputs_by_size(features.task_registry(spark, _TASKS))


@query("SELECT doc_id, quality, toxic FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels) WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def complete_rows(spark, sf):
    """FIL-13: rows without gaps whose key is listed."""
    rows = table(spark, sf, "labels", ["doc_id", "quality", "toxic"]).withColumn("quality", F.when(F.col("doc_id") % 4 != 0, F.col("quality")))
    return features.complete_rows(rows, ["quality", "toxic"], table(spark, sf, "documents", ["doc_id", "lang"]).where("lang <> 'en'").select("doc_id"), "doc_id")


@query("SELECT l_partkey % 50 AS task, l_returnflag AS method, round(avg(l_discount), 9) AS mean, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber > 5 GROUP BY ALL HAVING count(*) >= 3")
def enough_observations(spark, sf):
    """FIL-16: groups with at least three values."""
    li = table(spark, sf, "lineitem").where("l_linenumber > 5").select((F.col("l_partkey") % 50).alias("task"), F.col("l_returnflag").alias("method"), F.col("l_discount").alias("value"))
    return K.summary(li, least=3).select("task", "method", F.round("mean", 9).alias("mean"), "n")


@query("SELECT conv_id, count(*) - 1 AS n_edges FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def graphs_with_edges(spark, sf):
    """FIL-18: graphs without an edge are left out."""
    g = table(spark, sf, "conversations", ["conv_id", "turn"]).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    edges = F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x)
    return g.withColumn("edges", edges).where(features.has_edges(F.col("edges"))).select("conv_id", F.size("edges").cast("long").alias("n_edges"))


@query("""SELECT o_orderkey, origin, CASE origin WHEN 'cache' THEN 1.5 * o_custkey WHEN 'computed' THEN 2.0 * o_custkey ELSE 0.0 END::DOUBLE AS feature
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'cache' WHEN o_custkey % 3 = 1 THEN 'computed' ELSE 'zero' END AS origin FROM orders)""")
def feature_cache(spark, sf):
    """JOI-08: features from a cache table, computed once a key on a miss, zeros for what cannot be computed."""
    to = scratch_folder(spark)
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    o.where("o_custkey % 3 = 0").select("o_custkey", (1.5 * F.col("o_custkey")).alias("feature")).distinct().write.parquet(to)
    compute = lambda missing: missing.where("o_custkey % 3 = 1").withColumn("feature", 2.0 * F.col("o_custkey"))
    return C.cached(o, spark.read.parquet(to), "o_custkey", "feature", compute, F.lit(0.0)).select("o_orderkey", "origin", "feature")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows(spark, sf):
    """SRT-07: the first rows in order, for a log."""
    o = ragged.row_numbers(table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", name="_rn")
    return o.where("_rn < 25").drop("_rn")


@query("SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def least_energy(spark, sf):
    """SRT-05: the row of least value of each key."""
    return C.least_by(table(spark, sf, "lineitem", ["l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber"]), "l_partkey", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("""SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS items, p_size::DOUBLE AS size, 2.5::DOUBLE AS half,
  CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, CASE WHEN contains(lower(p_name), 'a') THEN 'red' ELSE 'grey' END AS colour, '''' || replace(p_name || '''s', '''', '''''') || '''' AS quoted FROM part""")
def parsed_texts(spark, sf):
    """STR-05, STR-07, STR-09: lists, pairs, yes and no, colours, quotes."""
    p = table(spark, sf, "part")
    pairs = keys.parse_pairs(F.concat(F.lit("size: "), F.col("p_size").cast("string"), F.lit(",half:2.5")))
    flag = F.element_at(F.array(F.lit(" Yes"), F.lit("0"), F.lit("TRUE"), F.lit("maybe")), F.col("p_size") % 4 + 1)
    return p.select("p_partkey", keys.parse_list(F.concat("p_type", F.lit(", ,"), "p_brand")).alias("items"), pairs["size"].alias("size"), pairs["half"].alias("half"), keys.truthy(flag).alias("flag"), keys.colour_of(F.col("p_name"), {"A": "red"}, "grey").alias("colour"), keys.quoted(F.concat("p_name", F.lit("'s"))).alias("quoted"))


@query("SELECT vec_id, len(embedding)::BIGINT + 2 AS width, (SELECT count(*) FROM range(0, 1) WHERE vec_id % 3 = 0)::BIGINT AS n_nan, round(embedding[2]::DOUBLE, 6) AS second FROM embeddings")
def scrubbed_vectors(spark, sf):
    """ARR-05: vectors end to end, infinities scrubbed."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding"])
    extra = F.array(F.when(F.col("vec_id") % 3 == 0, float("-inf")).otherwise(1.0), F.lit(2.0))
    v = numeric.scrub(F.concat(F.transform("embedding", lambda x: x.cast("double")), extra))
    return e.select("vec_id", F.size(v).cast("long").alias("width"), F.size(F.filter(v, lambda x: F.isnan(x))).cast("long").alias("n_nan"), F.round(F.get(v, F.lit(1)), 6).alias("second"))


@query("SELECT l_returnflag AS method, coalesce(round(avg(l_discount) FILTER (WHERE l_linestatus = 'F'), 9), -1.0) AS f, -1.0::DOUBLE AS absent FROM lineitem GROUP BY l_returnflag")
def leaf_values(spark, sf):
    """MAP-02: leaves of nested maps with a default."""
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_discount"])
    m = li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 9).alias("v"))
    cube = m.groupBy(F.col("l_returnflag").alias("method")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", F.create_map(F.lit("mean"), F.col("v"))))).alias("c"))
    return cube.select("method", tables.leaf(F.col("c"), "F", "mean", default=-1.0).alias("f"), tables.leaf(F.col("c"), "F", "median", default=-1.0).alias("absent"))


# ----------------------------------------------------------------- state and models
@query("""WITH d AS (SELECT event_type AS task, ts::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL), o AS (SELECT task, v, row_number() OVER (PARTITION BY task ORDER BY day) AS i, count(*) OVER (PARTITION BY task) AS n FROM d)
SELECT task, least(any_value(n), 6)::BIGINT AS seen, min(v) FILTER (WHERE i <= 3) AS nadir, least(any_value(n), 6) >= 3 AS frozen FROM o WHERE i <= 6 GROUP BY task""")
def calibrated_state(spark, sf):
    """STM-05: the least of the first three daily values of each task, frozen while three more come."""
    to = scratch_folder(spark)
    d = table(spark, sf, "events", ["ts", "event_type", "value"]).groupBy(F.col("event_type").alias("task"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    n = C.keep_first(d, ["task", "day"], ["v"])
    from pyspark.sql import Window as W

    ranked = n.withColumn("i", F.row_number().over(W.partitionBy("task").orderBy("day"))).where("i <= 6").withColumn("v", F.col("v"))
    for i in range(1, 7):  # one file a step: a stream takes them in this order
        ranked.where(F.col("i") == i).select("task", "v").coalesce(1).write.mode("append").parquet(to)
    stream = spark.readStream.schema("task string, v double").option("maxFilesPerTrigger", 1).parquet(to)
    state = S.calibrated_minimum(stream, "task", "v", 3)
    return S.run_to_end(state, ["task"])


@query("""WITH e AS (SELECT user_id || '/' || event_type AS task, epoch_ms(ts) AS ms, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
g AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY task ORDER BY ms, value) > 864000000, true) AS anew FROM e),
s AS (SELECT *, sum(anew::INT) OVER (PARTITION BY task ORDER BY ms, value) AS spell FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY task, spell ORDER BY ms, value) AS i, max(spell) OVER (PARTITION BY task) AS newest FROM s)
SELECT task, count(*)::BIGINT AS seen, min(value) FILTER (i <= 3) AS nadir, count(*) >= 3 AS frozen, max(ms) + 864000000 < (SELECT max(ms) - 86400000 FROM e) AS expired FROM r WHERE spell = newest GROUP BY task""")
def expiring_state(spark, sf):
    """STM-05: the least of the first three values of each user's events of a kind, begun anew after ten idle days; five files of six days."""
    to = scratch_folder(spark)
    e = table(spark, sf, "events", ["ts", "user_id", "event_type", "value"]).where("ts is not null")
    for k in range(5):
        e.where(F.floor((F.dayofmonth("ts") - 1) / 6) == k).repartition(1).write.mode("append").parquet(to)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(to)
    named = stream.where("user_id is not null and event_type is not null").withColumn("task", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    with S.rocksdb_state(spark):
        return S.run_to_end(S.expiring_minimum(named, "task", "ts", "value", 3, 864_000, "1 day"), ["task"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 311 = 0 THEN 2 ELSE 1 END AS step, CASE WHEN c_custkey % 311 = 0 THEN c_custkey + 1000 ELSE 2 * c_custkey END AS value FROM customer WHERE c_custkey % 311 <> 5
UNION ALL SELECT c_custkey, 2, c_custkey + 1000 FROM customer WHERE c_custkey % 311 = 5""")
def killed_steps(spark, sf):
    """UDF-06: a first tool that ignores signals and hangs, or brings its process down, for some rows; it is killed, and another tool takes over."""

    def hangs(x):
        import os
        import signal
        import time

        signal.signal(signal.SIGALRM, signal.SIG_IGN)
        if x % 311 == 0:
            time.sleep(60)
        if x % 311 == 5:
            os._exit(3)
        return 2 * x

    rows = table(spark, sf, "customer", ["c_custkey"])
    out = fallible.fallback_map(rows, "c_custkey", [hangs, lambda x: x + 1000], "bigint", seconds=1.0)
    return out.select("c_custkey", F.col("step") + 1, "value").toDF("c_custkey", "step", "value")


@query("""WITH e AS (SELECT event_type AS task, ((dayofmonth(ts) - 1) // 3)::INTEGER AS shard, abs(value) + 1 AS loss FROM events WHERE value IS NOT NULL),
c AS (SELECT task, shard, avg(loss) AS mean FROM e WHERE shard IN (2, 6) GROUP BY ALL),
n AS (SELECT e.*, CASE WHEN shard < 2 THEN 'warm-up' WHEN shard IN (2, 6) THEN 'calibration' ELSE 'weighted' END AS phase, (SELECT arg_max(mean, c.shard) FROM c WHERE c.task = e.task AND c.shard < e.shard) AS nadir FROM e)
SELECT task, shard, phase, count(*)::BIGINT AS n, round(any_value(nadir), 6) AS nadir, round(sum(CASE WHEN phase = 'weighted' THEN ln(loss / nadir + 1e-10) ELSE 0 END), 4) + 0.0 AS total FROM n GROUP BY task, shard, phase""")
def resumed_weighting(spark, sf):
    """STM-03, STM-05: ten shards of a run, the third and seventh calibrate; the stream stops after the fifth and goes on from its checkpoint."""
    to = scratch_folder(spark)
    e = table(spark, sf, "events", ["event_id", "ts", "event_type", "value"]).withColumn("shard", F.floor((F.dayofmonth("ts") - 1) / 3).cast("int"))
    rows = e.select("event_type", "shard", "event_id", (F.abs("value") + 1).alias("loss"))
    for first, end in ((0, 5), (5, 10)):
        for k in range(first, end):
            rows.where(F.col("shard") == k).repartition(1).write.mode("append").parquet(f"{to}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/in")
        with S.rocksdb_state(spark):
            out = S.run_to_end(S.nadir_ratios(stream, "event_type", "shard", "event_id", "loss", 2, 4), ["task", "shard"], f"{to}/run")
    return out.select("task", "shard", "phase", "n", F.round("nadir", 6).alias("nadir"), (F.round("total", 4) + 0.0).alias("total"))


_HASH = _MD5.format("l_orderkey || '-' || l_linenumber")


@query(f"""WITH x AS (SELECT l_returnflag AS task, l_quantity AS u, l_discount AS v, l_extendedprice AS y, ({_HASH} % 4 = 0) AS test, ({_HASH} // 4 % 3)::INTEGER AS fold FROM lineitem),
c AS (SELECT c, pow(10.0::DOUBLE, -3.0::DOUBLE + 4.0::DOUBLE * ({_MD5.format("'5/' || c")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS ridge FROM range(6) r(c)),
f AS (SELECT task, k, count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM x, range(-1, 3) r(k) WHERE NOT test AND fold <> k GROUP BY ALL),
w AS (SELECT task, k, c, ridge, mu, mv, my, (uy * vv * (1 + ridge) - vy * uv) / (uu * vv * (1 + ridge) * (1 + ridge) - uv * uv) AS a, (vy * uu * (1 + ridge) - uy * uv) / (uu * vv * (1 + ridge) * (1 + ridge) - uv * uv) AS b FROM f, c),
e AS (SELECT task, c, ridge, avg((my + a * (u - mu) + b * (v - mv) - y) ** 2) AS mse FROM x JOIN w USING (task) WHERE NOT test AND fold = k GROUP BY ALL),
z AS (SELECT task, min(struct_pack(mse, c, ridge)) AS z FROM e GROUP BY task)
SELECT task, z.c::INTEGER AS candidate, round(z.ridge, 9) AS ridge, round(sqrt(z.mse), 4) AS cv_rmse, n, mae FROM z JOIN (
  SELECT x.task, count(*)::BIGINT AS n, round(avg(abs(my + a * (u - mu) + b * (v - mv) - y)), 4) AS mae FROM x JOIN w ON w.task = x.task AND w.k = -1 JOIN z ON z.task = x.task AND z.z.c = w.c WHERE test GROUP BY ALL) USING (task)""")
def searched_heads(spark, sf):
    """UDA-01, UDA-02: a ridge regression a task, the penalty found by random search over folds, all from sums of products."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice"])
    h = keys.hash32("l_orderkey", F.lit("-"), "l_linenumber")
    rows = li.select(F.col("l_returnflag").alias("task"), F.array("l_quantity", "l_discount").alias("x"), F.col("l_extendedprice").alias("y"), (h % 4 == 0).alias("test"), (F.floor(h / 4) % 3).cast("int").alias("fold"))
    models = heads.fit_ridge(rows.where("not test"), "task", "x", "y", "fold", 2, heads.candidates(spark, 6, 5))
    seen = heads.predict(rows.where("test"), models, "task", "x").groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 4).alias("mae"))
    return models.select("task", "candidate", F.round("ridge", 9).alias("ridge"), F.round(F.sqrt("cv_mse"), 4).alias("cv_rmse")).join(seen, "task")


@query("""WITH x AS (SELECT l_linestatus AS task, l_returnflag <> 'A' AS y FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus = 'O')
SELECT task, count(*)::BIGINT AS n, round(avg(y::INT), 6) AS mean_y, round(avg(y::INT), 6) AS mean_p, true AS balanced FROM x GROUP BY task""")
def logistic_heads(spark, sf):
    """UDA-03: a logistic regression a task by Newton steps over sums; at the optimum its mean probability is the mean label, and so within the feature."""
    li = table(spark, sf, "lineitem", ["l_linestatus", "l_returnflag", "l_quantity", "l_discount"]).where("l_returnflag <> 'R' or l_linestatus = 'O'")
    rows = li.select(F.col("l_linestatus").alias("task"), F.array("l_quantity", "l_discount").alias("x"), (F.col("l_returnflag") != "A").cast("int").alias("y"))
    p = heads.predict(rows, heads.fit_logistic(rows, "task", "x", "y", 2, 0.0), "task", "x", "p", probability=True)
    gradient = F.avg(F.col("x")[0] * (F.col("p") - F.col("y")))
    return p.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.avg("p"), 6).alias("mean_p"), (F.abs(gradient) < 1e-6).alias("balanced"))


@query("""WITH x AS (SELECT l_returnflag AS task, l_quantity AS q, l_extendedprice AS y, ('0x' || substr(md5(l_orderkey || '-' || l_linenumber), 1, 8))::BIGINT % 4 = 0 AS test FROM lineitem),
m AS (SELECT task, regr_slope(y, q) AS a, regr_intercept(y, q) AS b FROM x WHERE NOT test GROUP BY task)
SELECT task, count(*)::BIGINT AS n, round(avg(abs(a * q + b - y)), 3) AS mae FROM x JOIN m USING (task) WHERE test GROUP BY task""")
def fitted_heads(spark, sf):
    """UDA-01, UDA-02, UDA-03: a model a task on a seeded split, target standardised, predictions of an ensemble averaged."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"])
    test = keys.hash32("l_orderkey", F.lit("-"), "l_linenumber") % 4 == 0
    rows = li.select(F.col("l_returnflag").alias("task"), F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), test.alias("test"))
    out = fallible.fit_predict(rows, "task", "x", "y", "test", fallible.least_squares, 1, members=3)
    return out.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 3).alias("mae"))


@query("SELECT l_returnflag AS task, round(avg(abs(l_extendedprice - l_quantity * 1500)), 6) AS score, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def running_metric(spark, sf):
    """EXT-03, EXT-04: a metric chosen by name, updated by batches after a reinit."""
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice"]).withColumn("task", F.col("l_returnflag"))
    m = M.Running(M.scorer("mae"), ["task"])
    y, p = F.col("l_extendedprice"), F.col("l_quantity") * 1500.0
    m.update(li, y, p).reinit()
    for k in range(3):
        m.update(li.where(F.col("l_linenumber") % 3 == k), y, p)
    return m.score().select("task", F.round("score", 6).alias("score"), "n")


@query("SELECT o_orderkey, v AS value, step FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 2 WHEN o_orderkey % 3 = 0 THEN o_orderkey * 3 END AS v, CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 END AS step FROM orders)")
def fallback_steps(spark, sf):
    """UDF-03, UDF-04, UDF-06: steps tried one after another; the first that works gives the value, none a null."""

    def even(x):
        if x % 2:
            raise ValueError("odd")
        return 2 * x

    def third(x):
        if x % 3:
            raise ValueError("not a third")
        return 3 * x

    out = fallible.fallback_map(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", [even, third], "bigint")
    return out.select("o_orderkey", "value", "step")


@query("SELECT event_type, round(sum(value), 4) AS total, count(value)::BIGINT AS n FROM events GROUP BY event_type")
def resumed_stream(spark, sf):
    """STM-03: a stream stopped after two thirds of its files goes on where it was; rows count once."""
    to = scratch_folder(spark)
    e = table(spark, sf, "events", ["event_id", "event_type", "value"])
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).repartition(4).write.mode("append").parquet(f"{to}/in")  # as many micro-batches for any input
        if k:
            stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/in")
            out = S.run_to_end(S.masked_totals(stream, ["event_type"], F.col("value")), ["event_type"], f"{to}/run")
    return out.select("event_type", F.round("total", 4).alias("total"), "n")


@query("SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS head, label::SMALLINT AS code FROM embeddings WHERE label = 3")
def cast_arrays(spark, sf):
    """PRJ-02, PRJ-03, FIL-03: elements and codes cast, columns renamed, one state selected."""
    e = table(spark, sf, "embeddings").where("label = 3")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("head"), F.col("label").cast("short").alias("code"))


@query("SELECT family, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'fast' WHEN o_orderpriority LIKE '4%' THEN 'none' ELSE 'slow' END AS family, o_totalprice FROM orders) GROUP BY family")
def task_families(spark, sf):
    """FIL-12, JOI-19: tasks by the prefix of their names, from a small table sent to every executor."""
    families = tables.dimension(spark, [("1", "fast"), ("2", "fast"), ("4", "none")], "prefix string, family string")
    o = table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]).withColumn("prefix", F.substring("o_orderpriority", 1, 1))
    named = o.join(F.broadcast(families), "prefix", "left").withColumn("family", F.coalesce("family", F.lit("slow")))
    return named.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT l_returnflag AS task, round(sum(l_tax), 4) AS total, round(avg(l_tax), 9) AS mean, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag")
def reduced_over_ranks(spark, sf):
    """AGG-28: sums, means and maxima of each rank's own rows, reduced over ranks."""
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_orderkey", "l_tax"])
    own = li.groupBy((F.col("l_orderkey") % 4).alias("rank"), F.col("l_returnflag").alias("task")).agg(F.sum("l_tax").alias("s"), F.count("l_tax").alias("n"), F.max("l_tax").alias("m"))
    return own.groupBy("task").agg(F.round(F.sum("s"), 4).alias("total"), F.round(F.sum("s") / F.sum("n"), 9).alias("mean"), F.max("m").alias("most"))


@query("SELECT conv_id, count(*)::BIGINT AS n_nodes, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def nested_graph_cache(spark, sf):
    """SNK-07, SRC-15: nested graphs written as Parquet and read again by key, the first table of two keeping its rows."""
    to = scratch_folder(spark)
    g = table(spark, sf, "conversations", ["conv_id", "turn"]).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    g.write.parquet(f"{to}/a")
    g.where("conv_id % 2 = 0").withColumn("turns", F.array().cast("array<bigint>")).write.parquet(f"{to}/b")
    cache = tables.keyed_cache([spark.read.parquet(f"{to}/a"), spark.read.parquet(f"{to}/b")], "conv_id", False)
    return cache.select("conv_id", F.size("turns").cast("long").alias("n_nodes"), "turns")


@query("SELECT count(*)::BIGINT AS n, sum(n_nationkey)::BIGINT AS keys, (count(*) + 6) // 7 AS batches FROM nation")
def batched_rows(spark, sf):
    """SRC-07: two columns in batches of seven rows."""
    n = keys_sum = batches = 0
    for batch in tables.row_batches(table(spark, sf, "nation"), ["n_nationkey", "n_name"], 7):
        batches, n, keys_sum = batches + 1, n + len(batch), keys_sum + sum(r.n_nationkey for r in batch)
    return spark.createDataFrame([(n, keys_sum, batches)], "n long, keys long, batches long")


@query("""WITH f AS (SELECT l_returnflag AS task, l_linenumber AS seed, round(avg(l_tax), 6) AS value FROM lineitem GROUP BY ALL)
SELECT task, seed::VARCHAR AS seed, 'tax' AS metric, value FROM f UNION ALL SELECT task, '_summary', 'tax_mean', round(avg(value), 9) FROM f GROUP BY task UNION ALL SELECT task, '_summary', 'tax_std', round(stddev_samp(value), 9) FROM f GROUP BY task""")
def result_summaries(spark, sf):
    """SNK-13, FIL-07: seeds and their summary."""
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_linenumber", "l_tax"])
    f = li.groupBy(F.col("l_returnflag").alias("task"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_tax"), 6).alias("value")).withColumns({"metric": F.lit("tax"), "method": F.lit("m")})
    return K.with_summary(f.withColumn("method", F.lit("m")), ["task", "method"]).select("task", "seed", "metric", F.round("value", 9).alias("value"))
