"""Queries over graphs and points: conversations are chains of turns, embeddings give coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import attention as A
from ..operators import features
from ..operators import graph as G
from ..sources.tables import table
from .registry import query
from .samples import _turn_edges

STEPS = 4
_EDGES = "e AS (SELECT a.conv_id, a.turn AS src, a.turn + 1 AS dst, a.role FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations", ["conv_id", "turn"]).withColumnRenamed("turn", "node").distinct()


@query(f"WITH {_EDGES} SELECT * FROM e UNION ALL SELECT conv_id, dst, src, role FROM e WHERE role <> 'system'")
def symmetrize_edges(spark, sf):
    """GRA-01, SET-09, FIL-10."""
    return G.symmetrise(_turn_edges(spark, sf), F.col("role") != "system").select("conv_id", "src", "dst", "role")


@query(f"""WITH {_EDGES}, w AS (SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn IN (a.turn + 1, a.turn + 2, a.turn - 2))
SELECT conv_id, min(src) AS src, max(dst) AS dst FROM (SELECT conv_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM w) v
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = v.conv_id AND e.src = v.src AND e.dst = v.dst) GROUP BY conv_id, v.src, v.dst""")
def virtual_edges(spark, sf):
    """GRA-02, FIL-19: turns two apart, without real pairs and repeats."""
    t = table(spark, sf, "conversations", ["conv_id", "turn"])
    # an equi-join on the shifted turn, not all pairs of a conversation
    shifted = t.select("conv_id", F.col("turn").alias("src"), F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2, F.col("turn") - 2)).alias("dst"))
    wanted = shifted.join(t.withColumnRenamed("turn", "dst"), ["conv_id", "dst"]).select("conv_id", "src", "dst")
    return G.virtual_edges(wanted, _turn_edges(spark, sf), "conv_id")


@query("""WITH c AS (SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN list_reverse(l[1:3]) ELSE l[1:3] END AS r, l[4] AS d FROM (SELECT p_brand, list(s ORDER BY rn) AS l FROM (
  SELECT p_brand, p_partkey AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 4 GROUP BY p_brand HAVING count(*) = 4)),
e AS (SELECT p_brand, unnest([struct_pack(s := r[1], t := d, k := 'spoke'), struct_pack(s := d, t := r[1], k := 'spoke'), struct_pack(s := r[2], t := d, k := 'spoke'), struct_pack(s := d, t := r[2], k := 'spoke'),
  struct_pack(s := r[3], t := d, k := 'spoke'), struct_pack(s := d, t := r[3], k := 'spoke'), struct_pack(s := r[2], t := r[1], k := 'ring'), struct_pack(s := r[3], t := r[2], k := 'ring'), struct_pack(s := r[1], t := r[3], k := 'ring')]) AS e FROM c)
SELECT DISTINCT p_brand, e.s AS src, e.t AS dst, e.k AS kind FROM e WHERE abs(e.s - e.t) <> 25""")
def star_and_ring(spark, sf):
    """GRA-02, WIN-13, FIL-19: each brand as a center with its dearest parts, some turned; parts 25 apart are joined already."""
    part = table(spark, sf, "part", ["p_brand", "p_partkey", "p_retailprice"])
    edges = part.select("p_brand", F.lit(0).cast("long").alias("src"), F.col("p_partkey").alias("dst"), "p_retailprice")
    centers = G.ranked_neighbours(edges, "p_brand", "p_retailprice").withColumn("turn", F.when(F.col("p_brand").endswith("1"), "S").otherwise("R"))
    real = part.select("p_brand", F.col("p_partkey").alias("src"), (F.col("p_partkey") + 25).alias("dst"))
    return G.without_real(G.star_and_ring(centers, "p_brand"), real, "p_brand")


@query("""WITH n AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
b AS (SELECT p_brand, i, CASE WHEN i % 2 = 0 THEN 'E' ELSE 'Z' END AS k, CASE WHEN i % 2 = 0 THEN 'Z' ELSE 'E' END AS inv, i - 1 AS s3, i + 2 AS s4,
  CASE WHEN i >= 4 THEN i - 4 WHEN i + 4 < n THEN i + 4 END AS s5, CASE WHEN i >= 3 THEN i - 3 WHEN i + 5 < n THEN i + 5 END AS s6 FROM n WHERE i % 5 = 3 AND i + 2 < n),
p AS (SELECT p_brand, s3 AS u, s4 AS v, k FROM b UNION SELECT p_brand, s5, s4, inv FROM b UNION SELECT p_brand, s3, s6, inv FROM b UNION SELECT p_brand, s5, s6, k FROM b),
e AS (SELECT p_brand, u AS src, v AS dst, k AS kind FROM p UNION SELECT p_brand, v, u, k FROM p)
SELECT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND abs(src - dst) NOT IN (1, 4)""")
def double_bond_edges(spark, sf):
    """GRA-02, FIL-19: parts of a brand in a row, joined with the next and the fourth next; every fifth bond has a geometry."""
    part = table(spark, sf, "part", ["p_brand", "p_partkey"])
    w = W.partitionBy("p_brand")
    n = part.select("p_brand", (F.row_number().over(w.orderBy("p_partkey")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    edges = n.select("p_brand", F.col("i").alias("src"), F.explode(F.array(F.col("i") + 1, F.col("i") + 4)).alias("dst"), "n").where("dst < n").drop("n")
    bonds = n.where("i % 5 = 3 and i + 2 < n").select("p_brand", F.col("i").alias("src"), (F.col("i") + 1).alias("dst"), F.when(F.col("i") % 2 == 0, "E").otherwise("Z").alias("kind"), (F.col("i") - 1).alias("s_src"), (F.col("i") + 2).alias("s_dst"))
    return G.without_real(G.across_double(bonds, edges, "p_brand"), edges, "p_brand")


@query(f"WITH {_EDGES}, n AS (SELECT conv_id, max(n) AS hub FROM (SELECT conv_id, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id) GROUP BY conv_id) SELECT conv_id, src, dst FROM e UNION ALL SELECT DISTINCT conv_id, turn, hub FROM conversations JOIN n USING (conv_id) UNION ALL SELECT DISTINCT conv_id, hub, turn FROM conversations JOIN n USING (conv_id)")
def virtual_node(spark, sf):
    """GRA-05."""
    return G.virtual_node(_nodes(spark, sf), _turn_edges(spark, sf).select("conv_id", "src", "dst"), "conv_id")[1]


@query("""SELECT a.vec_id AS src, b.vec_id AS dst, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))), 9) AS d
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def edge_gather(spark, sf):
    """JOI-14, MTH-08."""
    n = table(spark, sf, "embeddings", ["vec_id", "embedding"]).select(F.lit(0).alias("g"), F.col("vec_id").alias("node"), "embedding")
    e = n.select("g", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return G.gather(e, n, "g", ["embedding"]).select("src", "dst", F.round(numeric.distance(F.col("src_embedding"), F.col("dst_embedding")), 9).alias("d"))


@query("""WITH s AS (SELECT event_id, user_id, value / 25.0 AS x, max(value / 25.0) OVER (PARTITION BY user_id) AS m FROM events)
SELECT event_id, user_id, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY user_id), 9) AS weight FROM s""")
def segment_softmax(spark, sf):
    """AGG-21, MTH-12."""
    e = table(spark, sf, "events", ["event_id", "user_id", "value"]).withColumn("x", F.col("value") / 25.0)
    return G.segment_softmax(e, ["user_id"], "x").select("event_id", "user_id", F.round("weight", 9).alias("weight"))


_WALK = f"""{_EDGES}, n AS (SELECT DISTINCT conv_id, turn FROM conversations),
a AS (SELECT conv_id, src AS i, dst AS j FROM e UNION SELECT conv_id, dst, src FROM e UNION SELECT conv_id, turn, turn FROM n),
d AS (SELECT conv_id, i, count(*) AS degree FROM a GROUP BY ALL), t AS (SELECT conv_id, i, j, 1.0::DOUBLE / degree AS p FROM a JOIN d USING (conv_id, i)),
p1 AS (SELECT * FROM t), """ + ", ".join(f"p{k} AS (SELECT l.conv_id, l.i, r.j, sum(l.p * r.p) AS p FROM p{k - 1} l JOIN t r ON r.conv_id = l.conv_id AND r.i = l.j GROUP BY ALL)" for k in range(2, STEPS + 1)) + ", pw AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM p{k}" for k in range(1, STEPS + 1)) + ")"


def _walk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = G.transition(_nodes(spark, sf), _turn_edges(spark, sf), "conv_id")
    return t, G.walk_powers(t, "conv_id", STEPS)


@query(f"WITH {_WALK} SELECT conv_id, i AS node, k::INTEGER AS k, round(p, 9) AS p, round(ln(1 + degree), 9) AS log_deg FROM pw JOIN d USING (conv_id, i) WHERE i = j")
def rrwp_nodes(spark, sf):
    """GRA-03."""
    t, p = _walk(spark, sf)
    return G.rrwp_nodes(p, t, "conv_id").select("conv_id", "node", "k", F.round("p", 9).alias("p"), F.round("log_deg", 9).alias("log_deg"))


@query(f"WITH {_WALK} SELECT e.conv_id, e.src, e.dst, x.k::INTEGER AS k, round(0.5 * (x.p + y.p), 9) AS p FROM e JOIN pw x ON x.conv_id = e.conv_id AND x.i = e.src AND x.j = e.dst JOIN pw y ON y.conv_id = e.conv_id AND y.i = e.dst AND y.j = e.src AND y.k = x.k")
def rrwp_edges(spark, sf):
    """GRA-03."""
    _, p = _walk(spark, sf)
    return G.rrwp_edges(p, _turn_edges(spark, sf), "conv_id", STEPS).select("conv_id", "src", "dst", "k", F.round("p", 9).alias("p"))


@query(f"WITH {_WALK} SELECT conv_id, i::INTEGER AS node, k::INTEGER AS k, round(p, 9) AS p FROM pw WHERE i = j")
def rrwp_nested(spark, sf):
    """GRA-03, GRA-04: nested graphs, numpy."""
    size = _nodes(spark, sf).groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    ends = _turn_edges(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    nested = size.join(ends, "conv_id", "left").select("conv_id", "n", *[F.coalesce(F.col(f"e.{c}"), F.array().cast("array<bigint>")).alias(c) for c in ("src", "dst")])
    rows = G.rrwp_per_graph(nested, "conv_id", STEPS).select("conv_id", F.posexplode("node_walk").alias("node", "w"))
    return rows.select("conv_id", "node", F.posexplode("w").alias("k", "p")).select("conv_id", "node", (F.col("k") + 1).alias("k"), F.round("p", 9).alias("p"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(["x", "y", "z", "u", "v", "w"])])


_POINTS = "q AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings)"


@query(f"WITH {_POINTS}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM q GROUP BY label) SELECT label, round(sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 9) AS rmsd FROM q JOIN c USING (label) GROUP BY label")
def graph_rmsd(spark, sf):
    """AGG-19: to the label's centroid."""
    q = _points(spark, sf)
    c = q.groupBy("label").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    e2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))
    return G.graph_rmsd(q.join(c, "label"), "label", e2).select("label", F.round("rmsd", 9).alias("rmsd"))


_COV = "SELECT label, " + ", ".join([f"round(avg({a}), 9) AS c_{a}" for a in "xyzuvw"] + [f"round(covar_pop({a}, {b}) * count(*), 9) AS h_{a}_{b}" for a in "xyz" for b in "uvw"]) + " FROM q GROUP BY label"


@query(f"WITH {_POINTS} {_COV}")
def centroid_cov(spark, sf):
    """AGG-20."""
    r = G.centroid_covariance(_points(spark, sf), "label", list("xyz"), list("uvw"), F.lit(1.0))
    return r.select("label", *[F.round(c, 9).alias(c) for c in r.columns[1:]])


@query()
def kabsch_align(spark, sf):
    """GRA-06: rotations; the sign of a singular vector is free, so tested by invariants."""
    r = G.kabsch(G.centroid_covariance(_points(spark, sf), "label", list("xyz"), list("uvw"), F.lit(1.0)), "label", list("xyz"), list("uvw"))
    return r.select("label", F.transform("rotation", lambda x: F.round(x, 6)).alias("rotation"))


@query(f"WITH {_POINTS} SELECT DISTINCT label, 1.0::DOUBLE AS determinant, true AS orthogonal, true AS best FROM q")
def kabsch_invariants(spark, sf):
    """GRA-06: every rotation is proper and orthogonal, and leaves rotation times covariance symmetric, as only the best fit does."""
    cov = G.centroid_covariance(_points(spark, sf), "label", list("xyz"), list("uvw"), F.lit(1.0))
    r = G.kabsch(cov, "label", list("xyz"), list("uvw")).join(cov, "label")
    m = lambda i, j: F.get("rotation", F.lit(3 * i + j))
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    dot = lambda i, j: sum((m(i, k) * m(j, k) for k in range(3)), F.lit(0.0))
    flat = reduce(lambda a, b: a & b, [F.abs(dot(i, j) - (1.0 if i == j else 0.0)) < 1e-9 for i in range(3) for j in range(3)])
    h = lambda k, j: F.col(f"h_{'xyz'[k]}_{'uvw'[j]}")
    rh = lambda i, j: sum((m(i, k) * h(k, j) for k in range(3)), F.lit(0.0))
    even = reduce(lambda a, b: a & b, [F.abs(rh(i, j) - rh(j, i)) < 1e-9 * (1 + F.abs(rh(i, j))) for i, j in ((0, 1), (0, 2), (1, 2))])
    return r.select("label", F.round(det, 9).alias("determinant"), flat.alias("orthogonal"), even.alias("best"))


@query(f"WITH {_POINTS} SELECT round(2 * (" + " + ".join(f"pow(covar_samp({a}, {b}), 2)" for i, a in enumerate("xyzuvw") for b in "xyzuvw"[i + 1 :]) + ") / 30, 12) AS penalty FROM q")
def offdiag_cov(spark, sf):
    """AGG-22."""
    return G.off_diagonal_penalty(_points(spark, sf), list("xyzuvw")).select(F.round("penalty", 12).alias("penalty"))


@query("""SELECT label, list_sum(list_transform(z, lambda n: CASE WHEN n <= 2 THEN 2 WHEN n <= 10 THEN 8 ELSE 18 END))::BIGINT AS cap FROM (SELECT label, list(vec_id % 30 ORDER BY vec_id) AS z FROM embeddings GROUP BY label)""")
def electron_cap(spark, sf):
    """MTH-11: capacity by bands."""
    e = table(spark, sf, "embeddings", ["vec_id", "label"]).groupBy("label").agg(F.collect_list(F.col("vec_id") % 30).alias("z"))
    return e.select("label", numeric.electron_cap(F.col("z"), [(2, 2), (10, 8), (10**9, 18)]).cast("long").alias("cap"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::VARCHAR AS day, [CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END] AS codes FROM lineitem""")
def node_codes(spark, sf):
    """GRA-08, ARR-02."""
    li = table(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return features.code_columns(li, {"l_returnflag": ["A", "N"], "l_linestatus": ["O"]}, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day"])


@query("""SELECT s_suppkey, n_name, CASE WHEN s_nationkey % 3 = 0 THEN 0.0 ELSE s_nationkey / 2.0 END::DOUBLE AS weight, CASE WHEN s_acctbal < 0 AND s_nationkey % 3 = 0 THEN -1.0 WHEN s_nationkey % 3 = 0 THEN 0.0 ELSE s_nationkey / 2.0 END::DOUBLE AS filled
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def node_dimensions(spark, sf):
    """GRA-08, JOI-15, SRC-18, FIL-15."""
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") / 2.0).alias("weight"))
    s = features.with_dimension(table(spark, sf, "supplier"), dim, "s_nationkey", ["weight"]).join(dim.select("s_nationkey", "n_name"), "s_nationkey")
    return s.select("s_suppkey", "n_name", "weight", features.fill_sentinel(F.col("weight"), F.col("s_acctbal") < 0, F.lit(-1.0)).alias("filled"))


@query("""WITH c AS (SELECT DISTINCT conv_id, turn, len(text)::BIGINT AS v FROM conversations), g AS (SELECT conv_id % 4 AS shard, conv_id, count(*) AS n, list(v ORDER BY turn, v) AS v FROM c GROUP BY ALL)
SELECT shard, list(conv_id ORDER BY conv_id) AS graphs, list_concat([0], list(cum ORDER BY conv_id)) AS node_ptr, flatten(list(v ORDER BY conv_id)) AS vals FROM (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY conv_id)::INTEGER AS cum FROM g) GROUP BY shard""")
def csr_pack(spark, sf):
    """GRA-09, SNK-05."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 4).alias("shard"), "conv_id", "turn", F.length("text").cast("long").alias("v")).distinct()
    return features.pack_shard(c, "shard", "conv_id", ["turn"], "v").withColumnRenamed("values", "vals")


@query("SELECT DISTINCT conv_id % 4 AS shard, conv_id AS graph, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS node, len(text)::BIGINT AS value FROM conversations")
def csr_round_trip(spark, sf):
    """GRA-09: packed and unpacked."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 4).alias("shard"), "conv_id", "turn", F.length("text").cast("long").alias("v"))
    return features.unpack_shard(features.pack_shard(c, "shard", "conv_id", ["turn"], "v"), "shard")


@query()
def principal_components(spark, sf):
    """ARR-06: the sign of a component is free, so tested by its variances."""
    p = features.principal_components(table(spark, sf, "embeddings", ["vec_id", "embedding"]), "embedding", 8)
    return p.select("vec_id", F.transform("components", lambda x: F.round(F.abs(x), 6)).alias("components"))


@query("SELECT 8::BIGINT AS components, true AS centred, true AS uncorrelated, true AS descending, true AS within_total")
def principal_component_invariants(spark, sf):
    """ARR-06: means 0, covariances 0, variances descending, and together no more than the variance of the embeddings."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding"])
    p = features.principal_components(e, "embedding", 8).select(*[F.get("components", F.lit(i)).alias(f"c{i}") for i in range(8)])
    both = [(i, j) for i in range(8) for j in range(i + 1, 8)]
    row = p.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(8)], *[F.var_samp(f"c{i}").alias(f"v{i}") for i in range(8)], *[F.covar_samp(f"c{i}", f"c{j}").alias(f"k{i}_{j}") for i, j in both])
    total = e.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.var_samp("x").alias("v")).agg(F.sum("v").alias("total"))
    every = lambda tests: reduce(lambda a, b: a & b, tests)
    held = sum((F.col(f"v{i}") for i in range(8)), F.lit(0.0))
    return row.crossJoin(F.broadcast(total)).select(
        F.lit(8).cast("long").alias("components"), every([F.abs(f"m{i}") < 1e-9 for i in range(8)]).alias("centred"), every([F.abs(f"k{i}_{j}") < 1e-9 for i, j in both]).alias("uncorrelated"),
        every([F.col(f"v{i}") >= F.col(f"v{i + 1}") - 1e-12 for i in range(7)]).alias("descending"), (held <= F.col("total") + 1e-9).alias("within_total"),
    )


# ----------------------------------------------------------------- attention
_HEADS, _WIDTH = 2, 3
_INPUTS = 3  # of a turn: its length, its number, whether the user has it


def _weights(shape: list[int], seed: int) -> list:
    """Made-up parameters by rule, which the SQL below repeats: ((7 i + 3 j + 5 k + seed) mod 11 - 5) / 5."""
    i, *rest = shape
    if not rest:
        return [((5 * k + seed) % 11 - 5) / 5 for k in range(i)]
    step = 7 if len(rest) == 2 else 3
    return [_weights(rest, seed + step * a) for a in range(i)]


_LIN = "[round(list_sum([x[i + 1] * ((7 * h + 3 * d + 5 * i + {}) % 11 - 5) / 5.0::DOUBLE FOR i IN range(3)]), 6) FOR d IN range(3)]"
_MEAN = "[sum(exp(logit) * {0}[1]) / sum(exp(logit)), sum(exp(logit) * {0}[2]) / sum(exp(logit)), sum(exp(logit) * {0}[3]) / sum(exp(logit))]"
_ATTENTION = f"""t AS (SELECT conv_id, turn AS node, min(struct_pack(r := role, n := coalesce(len(text), 0))) AS m FROM conversations GROUP BY ALL),
f AS (SELECT conv_id, node, [least(m.n, 2000) / 1000.0::DOUBLE, node / 10.0::DOUBLE, CASE WHEN m.r = 'user' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END] AS x FROM t),
g AS (SELECT conv_id, node, h, {_LIN.format(0)} AS q, {_LIN.format(1)} AS k, {_LIN.format(2)} AS v FROM f, range(2) r(h)),
p AS (SELECT n.conv_id, n.h, m.node AS src, n.node AS dst, m.v AS v, [n.q[d] * m.k[d] * (0.5::DOUBLE + d / 4.0::DOUBLE) FOR d IN range(1, 4)] AS p
  FROM g n JOIN g m ON m.conv_id = n.conv_id AND m.h = n.h AND m.node IN (n.node - 1, n.node + 1, n.node + 2)),
e AS (SELECT conv_id, h, src, dst, v, [greatest(least(sign(p[d]) * sqrt(abs(p[d]) + 1e-9::DOUBLE), 5.0::DOUBLE), -5.0::DOUBLE) + (src - dst) * d / 8.0::DOUBLE FOR d IN range(1, 4)] AS score FROM p),
l AS (SELECT *, greatest(least(list_sum([score[d + 1] * ((3 * h + 5 * d + 3) % 11 - 5) / 5.0::DOUBLE FOR d IN range(3)]) / sqrt(3.0::DOUBLE) + abs(src - dst) / 4.0::DOUBLE, 5.0::DOUBLE), -5.0::DOUBLE) AS logit FROM e),
a AS (SELECT conv_id, dst AS node, h, count(*) AS degree, {_MEAN.format("v")} AS v, {_MEAN.format("score")} AS r FROM l GROUP BY ALL),
w AS (SELECT conv_id, node, h, coalesce(degree, 0) AS degree, [coalesce(v[d + 1] + list_sum([r[c + 1] * ((7 * h + 3 * d + 5 * c + 4) % 11 - 5) / 5.0::DOUBLE FOR c IN range(3)]), 0) FOR d IN range(3)] AS w
  FROM (SELECT conv_id, node, h FROM g) LEFT JOIN a USING (conv_id, node, h))"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, node and x of each turn."""
    c = table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    t = c.groupBy("conv_id", "turn").agg(F.min(F.struct("role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))).alias("m"))
    x = F.array(F.least(F.col("m.n"), F.lit(2000)) / 1000.0, F.col("turn") / 10.0, F.when(F.col("m.role") == "user", 1.0).otherwise(0.0))
    return t.select("conv_id", F.col("turn").alias("node"), x.alias("x"))


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    w = lambda s: A.of_head(_weights([_HEADS, _WIDTH, _INPUTS], s), "head")
    # rounded, for the sign under the root jumps at 0, which two engines may miss by 1e-17
    return A.heads(_turns(spark, sf), _HEADS).select("conv_id", "node", "head", *[F.transform(A.project(F.col("x"), w(s)), lambda v: F.round(v, 6)).alias(n) for s, n in enumerate("qkv")])


def _near(nodes: DataFrame) -> DataFrame:
    """Edges from the turns before, after and two after, with weights by channel and biases by distance."""
    apart = F.col("src") - F.col("dst")
    e = nodes.select("conv_id", "head", F.col("node").alias("dst"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1, F.col("node") + 2)).alias("src"))
    channel = lambda fn: F.transform(F.sequence(F.lit(1), F.lit(_WIDTH)), fn)
    return e.withColumns({"ew": channel(lambda d: 0.5 + d / 4.0), "eb": channel(lambda d: apart * d / 8.0), "bias": F.abs(apart) / 4.0})


@query(f"""WITH {_ATTENTION} SELECT conv_id, node, h::INTEGER AS head, degree::BIGINT AS degree, d::INTEGER AS channel,
  round(w[d + 1] * ((7 * h + 3 * d + 5) % 11 - 5) / 5.0::DOUBLE + w[d + 1] * ln(1 + degree) * ((7 * h + 3 * d + 10) % 11 - 5) / 5.0::DOUBLE, 7) + 0.0 AS out FROM w, range(3) c(d)""")
def graph_attention(spark, sf):
    """GRA-07, JOI-14, AGG-21: one attention layer over conversations: signed root, clamp, edge values and degree scaler."""
    nodes = _projected(spark, sf)
    out = A.attention(_near(nodes), nodes, "conv_id", _weights([_HEADS, _WIDTH], 3), _weights([_HEADS, _WIDTH, _WIDTH], 4), _weights([_HEADS, _WIDTH, 2], 5))
    return out.select("conv_id", "node", "head", "degree", F.posexplode("out").alias("channel", "out")).withColumn("out", F.round("out", 7) + 0.0)


@query(f"""WITH {_ATTENTION}, z AS (SELECT conv_id, h, [sum(exp(x) * v[1]) / sum(exp(x)), sum(exp(x) * v[2]) / sum(exp(x)), sum(exp(x) * v[3]) / sum(exp(x))] AS v FROM (SELECT conv_id, h, v, 3 * q[1] - k[2] AS x FROM g) GROUP BY ALL)
SELECT a.conv_id, [round(x, 7) + 0.0 FOR x IN list_concat(a.v, b.v)] AS pooled FROM z a JOIN z b ON b.conv_id = a.conv_id WHERE a.h = 0 AND b.h = 1""")
def graph_pooling(spark, sf):
    """GRA-07, AGG-21: one vector a conversation: turns weighted by a gated softmax in each head, heads joined."""
    pooled = A.attention_pool(_projected(spark, sf), "conv_id", 3 * F.get("q", F.lit(0)) - F.get("k", F.lit(1)), "v", _WIDTH)
    return A.joined_heads(pooled, ["conv_id"], "v", _HEADS).select("conv_id", F.transform("v", lambda x: F.round(x, 7) + 0.0).alias("pooled"))
