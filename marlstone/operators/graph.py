"""Graphs as node and edge tables: symmetry, gathers, random walks, segments, geometry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def symmetrise(edges: DataFrame, real: Column) -> DataFrame:
    """GRA-01, SET-09: every edge, and the reverse of those that are real."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.where(real).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)
    return edges.select("src", "dst", *others).unionByName(back)


def _both_ways(edges: DataFrame, graph: str) -> DataFrame:
    """graph, src, dst: every edge and its reverse once each, from one scan. Spark takes exploded rows for as small as the rows that they come
    from and would broadcast whole edge tables, through the driver; a join with them sorts and merges."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(graph, F.explode(ways).alias("e")).select(graph, "e.src", "e.dst").distinct().hint("merge")


def virtual_edges(wanted: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """FIL-19, GRA-02: wanted edges without those that exist in either direction, or that repeat."""
    both = _both_ways(edges, graph)
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    first = wanted.join(both, [graph, "src", "dst"], "left_anti").withColumns({"a": pair[0], "b": pair[1]})
    best = first.groupBy(graph, "a", "b").agg(F.min(F.struct("src", "dst")).alias("e"))
    return best.select(graph, "e.src", "e.dst")


def star_and_ring(centers: DataFrame, graph: str) -> DataFrame:
    """GRA-02, WIN-13: around each center with four neighbours or more, ranked best first: the first three, reversed where turn
    is 'S', are a, b, c and the fourth is d; spokes join a, b, c with d both ways, a ring goes b to a, c to b, a to c.
    centers: graph, neighbours, turn. Give the result to without_real for edges that exist."""
    first = F.slice("neighbours", 1, 3)
    c = centers.where(F.size("neighbours") >= 4).select(graph, F.when(F.col("turn") == "S", F.reverse(first)).otherwise(first).alias("_r"), F.get("neighbours", F.lit(3)).alias("_d"))
    r = lambda i: F.get("_r", F.lit(i))
    edge = lambda u, v, kind: F.struct(u.alias("src"), v.alias("dst"), F.lit(kind).alias("kind"))
    spokes = [e for i in range(3) for e in (edge(r(i), F.col("_d"), "spoke"), edge(F.col("_d"), r(i), "spoke"))]
    ring = [edge(r(1), r(0), "ring"), edge(r(2), r(1), "ring"), edge(r(0), r(2), "ring")]
    return c.select(graph, F.explode(F.array(*spokes, *ring)).alias("e")).select(graph, "e.src", "e.dst", "e.kind")


def across_double(bonds: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """GRA-02: edges across double bonds of known geometry, both ways. bonds: graph, src, dst, kind ('E' or 'Z'), s_src and s_dst,
    the reference neighbours of both ends. The other neighbour of an end (o_src, o_dst) is its least one besides the bond and the reference.
    s_src to s_dst and o_src to o_dst are of the bond's kind, o_src to s_dst and s_src to o_dst of the other; what is absent is left out."""
    both = _both_ways(edges, graph).withColumnsRenamed({"src": "_u", "dst": "_v"})
    known = bonds.where(F.col("kind").isin("E", "Z") & (F.col("s_src") >= 0) & (F.col("s_dst") >= 0))

    def other(end: str, far: str) -> DataFrame:
        own = known.select(graph, "src", "dst", F.col(end).alias("_u"), F.col(far).alias("_far"), F.col(f"s_{end}").alias("_s")).join(both, [graph, "_u"])
        return own.where("_v <> _far and _v <> _s").groupBy(graph, "src", "dst").agg(F.min("_v").alias(f"o_{end}")).hint("merge")

    full = known.join(other("src", "dst"), [graph, "src", "dst"], "left").join(other("dst", "src"), [graph, "src", "dst"], "left")
    turned = F.when(F.col("kind") == "E", "Z").otherwise("E")
    pairs = [("s_src", "s_dst", F.col("kind")), ("o_src", "s_dst", turned), ("s_src", "o_dst", turned), ("o_src", "o_dst", F.col("kind"))]
    edge = lambda u, v, kind: F.struct(F.col(u).alias("src"), F.col(v).alias("dst"), kind.alias("kind"))
    listed = F.array(*[e for u, v, k in pairs for e in (edge(u, v, k), edge(v, u, k))])
    return full.select(graph, F.explode(listed).alias("e")).select(graph, "e.src", "e.dst", "e.kind").where("src is not null and dst is not null")


def without_real(wanted: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """FIL-19: wanted edges once each by kind, without those whose ends a real edge joins in either direction."""
    both = _both_ways(edges, graph)
    return wanted.distinct().join(both, [graph, "src", "dst"], "left_anti")


def ranked_neighbours(edges: DataFrame, graph: str, priority: str, most: int = 4) -> DataFrame:
    """WIN-13: each center's neighbours by priority, highest first."""
    w = W.partitionBy(graph, "src").orderBy(F.desc(priority), "dst")
    top = edges.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    listed = top.groupBy(graph, "src").agg(F.sort_array(F.collect_list(F.struct("_rn", "dst"))).alias("_l"))
    return listed.select(graph, F.col("src").alias("center"), F.transform("_l", lambda x: x["dst"]).alias("neighbours"))


def gather(edges: DataFrame, nodes: DataFrame, graph: str, values: list[str]) -> DataFrame:
    """JOI-14: both ends' node values beside each edge, as src_v and dst_v."""
    side = lambda end: nodes.select(graph, F.col("node").alias(end), *[F.col(v).alias(f"{end}_{v}") for v in values])
    return edges.join(side("src"), [graph, "src"]).join(side("dst"), [graph, "dst"])


def virtual_node(nodes: DataFrame, edges: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """GRA-05: one more node a graph, joined both ways with every node; other columns are null there."""
    size = nodes.groupBy(graph).agg(F.count("*").alias("node"))
    hub = size.withColumnRenamed("node", "hub")
    links = nodes.select(graph, "node").join(hub, graph)
    out = links.select(graph, F.col("node").alias("src"), F.col("hub").alias("dst")).union(links.select(graph, "hub", "node"))
    return nodes.unionByName(size, allowMissingColumns=True), edges.unionByName(out, allowMissingColumns=True)


def transition(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """GRA-03: row-normalised adjacency with self-loops: graph, i, j, p."""
    own = F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))
    loop = F.array(F.struct(F.col("node").alias("i"), F.col("node").alias("j")))
    # one explode over both tables' rows: what follows needs the pairs of all of them by graph
    rows = edges.select(graph, own.alias("p")).unionByName(nodes.select(graph, loop.alias("p")))
    a = rows.select(graph, F.explode("p").alias("p")).select(graph, "p.i", "p.j").distinct()
    degree = a.groupBy(graph, "i").agg(F.count("*").alias("degree"))
    return a.join(degree, [graph, "i"]).select(graph, "i", "j", (1.0 / F.col("degree")).alias("p"), "degree")


def walk_powers(t: DataFrame, graph: str, steps: int) -> DataFrame:
    """GRA-03: graph, k, i, j, p of the powers 1..steps by repeated sparse products."""
    step = t.select(graph, "i", "j", "p")
    out = power = step.withColumn("k", F.lit(1))
    for k in range(2, steps + 1):
        left = power.select(graph, "i", F.col("j").alias("m"), F.col("p").alias("a"))
        right = step.select(graph, F.col("i").alias("m"), "j", F.col("p").alias("b"))
        power = left.join(right, [graph, "m"]).groupBy(graph, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("p")).withColumn("k", F.lit(k)).select(graph, "i", "j", "p", "k")
        power = written(power)  # else the plan of the last power repeats all before it
        out = out.unionByName(power)
    return out


def rrwp_nodes(powers: DataFrame, t: DataFrame, graph: str) -> DataFrame:
    """GRA-03: return probability of each node at each step, and log_deg = log(degree + 1)."""
    degree = t.select(graph, "i", "degree").distinct()
    own = powers.where("i = j").select(graph, "i", "k", "p")
    return own.join(degree, [graph, "i"]).select(graph, F.col("i").alias("node"), "k", "p", F.log1p("degree").alias("log_deg"))


def rrwp_edges(powers: DataFrame, edges: DataFrame, graph: str, steps: int) -> DataFrame:
    """GRA-03: symmetric walk probability of each edge at each step."""
    grid = edges.select(graph, "src", "dst").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = powers.select(graph, "k", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("p").alias("p1"))
    back = powers.select(graph, "k", F.col("i").alias("dst"), F.col("j").alias("src"), F.col("p").alias("p2"))
    both = grid.join(ahead, [graph, "k", "src", "dst"], "left").join(back, [graph, "k", "src", "dst"], "left")
    return both.select(graph, "src", "dst", "k", (0.5 * (F.coalesce("p1", F.lit(0.0)) + F.coalesce("p2", F.lit(0.0)))).alias("p"))


def rrwp_per_graph(graphs: DataFrame, graph: str, steps: int, edgeless: str = "selfloop") -> DataFrame:
    """GRA-03, GRA-04: the same for nested graphs (n, src array, dst array) with numpy, one row a graph:
    node_walk array of steps values a node. edgeless: 'selfloop' walks stay, 'zero' gives zeros."""

    def run(batches):
        for batch in batches:
            out = []
            for n, src, dst in zip(*(batch[i].to_pylist() for i in (1, 2, 3)), strict=True):
                if not src and edgeless == "zero":
                    out.append([[0.0] * steps for _ in range(n)])
                    continue
                a = np.eye(n)
                a[src, dst] = a[dst, src] = 1
                t = a / a.sum(1, keepdims=True)
                p, diagonals = np.eye(n), []
                for _ in range(steps):
                    p = p @ t
                    diagonals.append(np.diag(p))
                out.append(np.stack(diagonals, 1).tolist() if n else [])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(out, pa.list_(pa.list_(pa.float64())))], [graph, "node_walk"])

    return graphs.select(F.col(graph).cast("long"), "n", "src", "dst").mapInArrow(run, f"{graph} long, node_walk array<array<double>>")


def segment_softmax(df: DataFrame, segment: list[str], score: str, name: str = "weight") -> DataFrame:
    """AGG-21, MTH-12: softmax of score within segments, shifted by the largest; two aggregates and joins, so
    a hot segment is combined map-side."""
    top = df.groupBy(*segment).agg(F.max(score).alias("_top"))
    e = df.join(top, segment).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    z = e.groupBy(*segment).agg(F.sum("_e").alias("_z"))
    return e.join(z, segment).withColumn(name, F.col("_e") / F.col("_z")).drop("_e", "_z", "_top")


def graph_rmsd(pairs: DataFrame, graph: str, error2: Column) -> DataFrame:
    """AGG-19: root of the mean squared error per graph, the count at least 1."""
    return pairs.groupBy(graph).agg(F.sqrt(F.sum(error2) / F.greatest(F.count(error2), F.lit(1))).alias("rmsd"))


def centroid_covariance(df: DataFrame, graph: str, a: list[str], b: list[str], weight: Column) -> DataFrame:
    """AGG-20: weighted centroids of two point sets and their cross-covariance h_ij = sum w (a_i - ca_i)(b_j - cb_j)."""
    w = weight
    s = lambda x: F.sum(w * x)
    sums = [F.sum(w).alias("_sum"), *[s(F.col(c)).alias(f"_1_{c}") for c in [*a, *b]], *[s(F.col(x) * F.col(y)).alias(f"_2_{x}_{y}") for x in a for y in b]]
    g = df.groupBy(graph).agg(*sums)
    centers = [(F.col(f"_1_{c}") / F.col("_sum")).alias(f"c_{c}") for c in [*a, *b]]
    h = [(F.col(f"_2_{x}_{y}") - F.col(f"_1_{x}") * F.col(f"_1_{y}") / F.col("_sum")).alias(f"h_{x}_{y}") for x in a for y in b]
    return g.select(graph, *centers, *h)


def off_diagonal_penalty(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-22: sum of squared covariances off the diagonal over D (D - 1); 0 for fewer than two rows."""
    d = len(columns)
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    total = sum((F.coalesce(F.covar_samp(x, y), F.lit(0.0)) * F.coalesce(F.covar_samp(x, y), F.lit(0.0)) for x, y in pairs), F.lit(0.0))
    return df.agg(F.when(F.count("*") < 2, 0.0).otherwise(2.0 * total / (d * (d - 1))).alias("penalty"))


def kabsch(cov: DataFrame, graph: str, a: list[str], b: list[str], ridge: tuple[float, ...] = (0.0, 0.0, 0.0)) -> DataFrame:
    """GRA-06: rotation (9 values, row by row) that best takes the first set onto the second, from centroid_covariance."""
    names = [f"h_{x}_{y}" for x in a for y in b]

    def run(batches):
        for batch in batches:
            table = np.array([batch[1 + i].to_pylist() for i in range(9)], float).T.reshape(-1, 3, 3)
            out = []
            for h in table:
                u, _, vt = np.linalg.svd(h + np.diag(ridge))
                d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
                out.append((vt.T @ np.diag([1, 1, d]) @ u.T).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(out, pa.list_(pa.float64()))], [graph, "rotation"])

    kind = dict(cov.dtypes)[graph]
    return cov.select(graph, *names).mapInArrow(run, f"{graph} {kind}, rotation array<double>")
