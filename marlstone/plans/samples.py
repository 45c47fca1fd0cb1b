"""Queries that form samples: unions, ragged arrays, chunks, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, numeric
from ..operators import batching as B
from ..operators import ragged as R
from ..operators.prefix_pack import prefix_pack
from ..sources.tables import table
from .registry import query


@query("""SELECT source, source_order, key, measure, size, acctbal FROM (
  SELECT 'part' AS source, 0 AS source_order, p_partkey AS key, p_retailprice AS measure, p_size AS size, NULL::DOUBLE AS acctbal FROM part
  UNION ALL SELECT 'customer', 1, c_custkey, NULL, NULL, c_acctbal FROM customer
  UNION ALL SELECT 'supplier', 2, s_suppkey, NULL, NULL, s_acctbal FROM supplier)""")
def outer_union_padded(spark, sf):
    """SET-05, T20."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("measure"), F.col("p_size").alias("size"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"))
    return B.outer_union({"supplier": s, "part": p, "customer": c}, "part")


_PTR = "p AS (SELECT conv_id, count(*)::BIGINT AS n_nodes, (sum(count(*)) OVER (ORDER BY conv_id) - count(*))::BIGINT AS node_ptr FROM conversations GROUP BY conv_id)"


def _turn_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Turn to next turn; an edge from a system turn is virtual."""
    t = table(spark, sf, "conversations", ["conv_id", "turn", "role"])
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("src"), (F.col("turn") + 1).alias("dst"), "role")


@query(f"WITH {_PTR} SELECT * FROM p")
def csr_offsets(spark, sf):
    """WIN-02, AGG-23."""
    return R.offsets(table(spark, sf, "conversations", ["conv_id"]), "conv_id")


@query(f"""WITH {_PTR} SELECT a.conv_id, a.turn AS src, a.turn + 1 AS dst, a.turn + node_ptr AS src_global, a.turn + 1 + node_ptr AS dst_global
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 JOIN p ON p.conv_id = a.conv_id""")
def global_edge_ids(spark, sf):
    """PRJ-07, GRA-09."""
    ptr = R.offsets(table(spark, sf, "conversations", ["conv_id"]), "conv_id")
    return R.rebase(_turn_edges(spark, sf).drop("role"), ptr, "conv_id")


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(["click", "view", "purchase"])) + " ELSE 3 END::INTEGER AS code FROM events")
def vocab_encode(spark, sf):
    """ARR-02, GRA-08."""
    return table(spark, sf, "events").select("event_id", numeric.encode(F.col("event_type"), ["click", "view", "purchase"]).alias("code"))


@query("""WITH m AS (SELECT conv_id, turn, role = 'user' AS u, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS k FROM conversations)
SELECT conv_id, list(CASE WHEN u THEN k * 10 END ORDER BY turn) AS aligned FROM m GROUP BY conv_id""")
def sparse_alignment(spark, sf):
    """JOI-17, ARR-04: 10, 20, ... onto the user turns of each conversation."""
    c = table(spark, sf, "conversations", ["conv_id", "turn", "role"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    mask = F.transform("t", lambda x: x["role"] == "user")
    n = F.size(F.filter(mask, lambda m: m))
    values = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i * 10)).otherwise(F.array().cast("array<int>"))
    return c.select("conv_id", R.align(values, mask).alias("aligned"))


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::BIGINT - 1 AS chunk FROM orders")
def ntile_chunks(spark, sf):
    """WIN-06."""
    return R.chunks(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 7)


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS part FROM orders")
def fixed_ranges(spark, sf):
    """WIN-07."""
    return R.fixed_ranges(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 1000)


@query("SELECT s_suppkey, s_nationkey, ((dense_rank() OVER (ORDER BY s_nationkey) - 1) // 4)::BIGINT AS grp FROM supplier")
def group_shards(spark, sf):
    """WIN-08."""
    return R.group_shards(table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]), "s_nationkey", 4)


_PACK = """WITH RECURSIVE o AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS part, doc_id, n_chars AS n, (row_number() OVER (ORDER BY doc_id) - 1) % 128 + 1 AS i FROM documents),
r AS (
  SELECT part, doc_id, i, 0::BIGINT AS batch, CASE WHEN n >= 20000 THEN NULL ELSE n END AS used FROM o WHERE i = 1
  UNION ALL
  SELECT o.part, o.doc_id, o.i, CASE WHEN o.n >= 20000 OR r.used IS NULL OR r.used + o.n > 20000 THEN r.batch + 1 ELSE r.batch END,
         CASE WHEN o.n >= 20000 THEN NULL WHEN r.used IS NULL OR r.used + o.n > 20000 THEN o.n ELSE r.used + o.n END
  FROM r JOIN o ON o.part = r.part AND o.i = r.i + 1
)"""


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return B.budget_pack(R.fixed_ranges(table(spark, sf, "documents", ["doc_id", "n_chars"]), "doc_id", 128), "part", ["doc_id"], "n_chars", 20_000)


@query(_PACK + " SELECT part, doc_id, batch FROM r")
def budget_pack(spark, sf):
    """WIN-09, T22."""
    return _packed(spark, sf).select("part", "doc_id", "batch")


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
r AS (
  SELECT doc_id, i, 0::BIGINT AS batch, CASE WHEN n >= 20000 THEN NULL ELSE n END AS used FROM o WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, CASE WHEN o.n >= 20000 OR r.used IS NULL OR r.used + o.n > 20000 THEN r.batch + 1 ELSE r.batch END,
         CASE WHEN o.n >= 20000 THEN NULL WHEN r.used IS NULL OR r.used + o.n > 20000 THEN o.n ELSE r.used + o.n END
  FROM r JOIN o ON o.i = r.i + 1
) SELECT doc_id, batch FROM r""")
def budget_pack_whole(spark, sf):
    """WIN-09: all documents as one ordered group, packed as a parallel prefix."""
    return prefix_pack(table(spark, sf, "documents", ["doc_id", "n_chars"]), ["doc_id"], "n_chars", 20_000).select("doc_id", "batch")


@query("""WITH b AS (SELECT DISTINCT (l_shipdate::DATE - DATE '1990-01-01') // 30 AS d FROM lineitem), n AS (SELECT row_number() OVER (ORDER BY d) - 1 AS batch FROM b), c AS (SELECT count(*) AS n FROM n),
u AS (SELECT batch, batch AS slot FROM n UNION ALL SELECT batch, batch + c.n FROM n, c WHERE batch < (4 - c.n % 4) % 4)
SELECT batch::BIGINT AS batch, slot::BIGINT AS slot, (slot % 4)::BIGINT AS rank, (slot // 4)::BIGINT AS step FROM u""")
def rank_stripe(spark, sf):
    """WIN-10."""
    days = table(spark, sf, "lineitem", ["l_shipdate"]).select(F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")) / 30).alias("d")).distinct()
    return B.stripe(R.row_numbers(days, "d", name="batch").select(F.col("batch").cast("long").alias("batch")), 4)


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT s_suppkey, e::INTEGER AS epoch FROM supplier, n, range(0, ((32 * 20 + n - 1) // n)::BIGINT) t(e)),
r AS (SELECT s_suppkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(s_suppkey::VARCHAR || '-5-' || epoch::VARCHAR), s_suppkey) - 1 + epoch * n AS x FROM p, n)
SELECT s_suppkey, epoch, (x // 32)::BIGINT AS batch, (x % 32)::BIGINT AS slot FROM r WHERE x < 640""")
def cycle_batches(spark, sf):
    """WIN-11, T24."""
    return B.cycle_batches(table(spark, sf, "supplier", ["s_suppkey"]), "s_suppkey", 32, 20, 5)


@query("""WITH n AS (SELECT max(c_nationkey) AS m FROM customer) SELECT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_custkey % 25""")
def zip_cycling(spark, sf):
    """JOI-16: each customer as a main batch with one of 25 nations in turn."""
    main = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("batch"))
    other = table(spark, sf, "nation").select(F.col("n_nationkey").alias("batch"), "n_name")
    return B.zip_cycling(main, other, 25).select("c_custkey", F.col("other_batch").cast("int").alias("n_nationkey"), "n_name")


@query("""WITH s AS (SELECT n_nationkey, n_nationkey + 10 AS size, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation), t AS (SELECT count(*) AS n, sum(size) AS s FROM s)
SELECT ((64 // n) * t.s + (SELECT coalesce(sum(size), 0) FROM s, t WHERE rn <= 64 % n))::BIGINT AS total FROM t""")
def cycled_epoch_total(spark, sf):
    """AGG-23."""
    s = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") + 10).alias("size"))
    return B.epoch_total(s, "size", 64, "n_nationkey").select(F.col("total").cast("long").alias("total"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn <= greatest(1, floor(n * 0.3::DOUBLE))")
def prefix_subset(spark, sf):
    """SRT-06."""
    return R.prefix_subset(table(spark, sf, "orders", ["o_orderkey"]), "o_orderkey", 0.3).select("o_orderkey")


@query("SELECT p_partkey, 'shard_' || CASE WHEN len((p_partkey % 40)::VARCHAR) < 3 THEN lpad((p_partkey % 40)::VARCHAR, 3, '0') ELSE (p_partkey % 40)::VARCHAR END || '.parquet' AS path, (p_partkey % 40)::INTEGER AS shard FROM part")
def shard_paths(spark, sf):
    """STR-03, STR-04, SRC-20: the name of a shard and back."""
    p = table(spark, sf, "part", ["p_partkey"]).withColumn("path", F.concat(F.lit("shard_"), keys.zero_padded(F.col("p_partkey") % 40, 40), F.lit(".parquet")))
    return p.select("p_partkey", "path", keys.shard_of_path(F.col("path")).alias("shard"))


@query("""SELECT n_nationkey, least(step + 1, 10)::DOUBLE / 10 * 1e-3 AS warm, round(CASE WHEN step < 10 THEN 1e-3 * (step + 1) / 10 ELSE 1e-5 + 0.5 * (1e-3 - 1e-5) * (1 + cos(pi() * least(1.0, (step - 10) / 40.0))) END, 12) AS rate
FROM (SELECT n_nationkey, n_nationkey * 2 AS step FROM nation)""")
def warmup_cosine(spark, sf):
    """WIN-16."""
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("step"))
    warm = F.least(F.col("step") + 1, F.lit(10)).cast("double") / 10 * 1e-3
    return n.select("n_nationkey", warm.alias("warm"), F.round(numeric.warmup_cosine(F.col("step"), 10, 50, 1e-3, 1e-5), 12).alias("rate"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE * 0.25::DOUBLE + embedding[2]::DOUBLE * 0.75::DOUBLE, 9) AS first_blend, round(exp(-2.0::DOUBLE * (embedding[1]::DOUBLE - 0.1::DOUBLE) * (embedding[1]::DOUBLE - 0.1::DOUBLE)), 9) AS rbf,
  embedding[6]::DOUBLE AS z2, false AS flat, true AS flattened FROM embeddings""")
def array_kernels(spark, sf):
    """ARR-01, ARR-03, MTH-07, FIL-14: points, blends, radial basis, flatness."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding"])
    v = F.transform("embedding", lambda x: x.cast("double"))
    points = numeric.triples(F.slice(v, 1, 6))
    flat = F.transform(points, lambda p: F.array(p[0], p[1], F.lit(0.0)))
    a, b = F.slice(v, 1, 1), F.slice(v, 2, 1)
    return e.select("vec_id", F.round(numeric.blend(a, b, 0.25)[0], 9).alias("first_blend"), F.round(numeric.radial_basis(v[0], [0.1], 2.0)[0], 9).alias("rbf"), F.get(points[1], F.lit(2)).alias("z2"), numeric.is_flat(points).alias("flat"), numeric.is_flat(flat).alias("flattened"))
