"""Attention over graphs as tables: heads are rows, a node's or edge's channels an array.

A layer gathers both ends of each edge (two joins), turns them into scores and logits with native expressions, and mixes by one
aggregate: since exp(logit) is summed beside exp(logit) times each channel, the softmax over a segment needs no join back, and
a node that receives a third of all edges is combined before the shuffle. Parameters (weights by head) are small literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9  # under the root of a score


def literal(values: list) -> Column:
    """A parameter as a column: nested lists of numbers as nested arrays."""
    return F.array(*[literal(v) if isinstance(v, list) else F.lit(float(v)) for v in values])


def of_head(values: list, head: str) -> Column:
    """The head's own part of a parameter whose first axis is the head."""
    return F.get(literal(values), F.col(head).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def project(x: Column, weights: Column, bias: Column | None = None) -> Column:
    """A linear map: weights has one array of input weights for each output channel."""
    out = F.transform(weights, lambda w: dot(x, w))
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)


def signed_root(x: Column) -> Column:
    """sign(x) sqrt(|x|), with EPS under the root where x is not 0."""
    return F.signum(x) * F.sqrt(F.abs(x) + EPS)


def clamped(x: Column, most: float | None) -> Column:
    return x if most is None else F.greatest(F.least(x, F.lit(float(most))), F.lit(-float(most)))


def heads(df: DataFrame, n: int, name: str = "head") -> DataFrame:
    """One row for each head of each row."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def segment_mix(df: DataFrame, segment: list[str], logit: Column, arrays: dict[str, int], bounded: bool, count: str | None = None) -> DataFrame:
    """GRA-07, AGG-21: for each segment the softmax-weighted mean of arrays (name: its length), and count: rows with a logit.

    Rows whose logit is null weigh nothing; a segment of such rows alone has zeros. bounded: the logits are known to be small
    (a clamp), so that their exponentials can be summed as they are; else the largest of each segment is found first."""
    rows = df.withColumn("_l", logit)
    if not bounded:
        top = rows.groupBy(*segment).agg(F.max("_l").alias("_top"))
        rows = rows.join(top, segment).withColumn("_l", F.col("_l") - F.col("_top")).drop("_top")
    e = rows.withColumn("_e", F.exp("_l"))
    sums = [F.sum(F.col("_e") * F.get(name, F.lit(i))).alias(f"_{name}_{i}") for name, n in arrays.items() for i in range(n)]
    out = e.groupBy(*segment).agg(F.sum("_e").alias("_z"), F.count("_e").alias("_n"), *sums)
    mean = lambda name, i: F.coalesce(F.col(f"_{name}_{i}") / F.col("_z"), F.lit(0.0))
    return out.select(*segment, *[F.array(*[mean(name, i) for i in range(n)]).alias(name) for name, n in arrays.items()], *([F.col("_n").alias(count)] if count else []))


def edge_scores(edges: DataFrame, nodes: DataFrame, graph: str, mix: list, clamp: float | None = 5.0, head: str = "head") -> DataFrame:
    """GRA-07: graph, head, src, dst, v (of the source), score (array) and logit of each edge and head.

    nodes: graph, node, head, q, k, v; edges: graph, src, dst, head, ew, eb (arrays over channels), bias. The score of a channel is the
    clamped signed root of q k ew, plus eb; the logit is their mix (head: channel weights) over the root of the number of channels,
    plus bias, clamped too."""
    width = len(mix[0])
    source = nodes.select(graph, F.col("node").alias("src"), head, F.col("k").alias("_k"), "v")
    target = nodes.select(graph, F.col("node").alias("dst"), head, F.col("q").alias("_q"))
    both = edges.join(source, [graph, "src", head]).join(target, [graph, "dst", head])
    product = F.zip_with(F.zip_with("_q", "_k", lambda a, b: a * b), "ew", lambda a, b: a * b)
    score = F.zip_with(F.transform(product, lambda x: clamped(signed_root(x), clamp)), "eb", lambda a, b: a + b)
    scored = both.withColumn("score", score)
    logit = clamped(dot(F.col("score"), of_head(mix, head)) * width**-0.5 + F.col("bias"), clamp)
    return scored.select(graph, head, "src", "dst", "v", "score", logit.alias("logit"))


def attention(edges: DataFrame, nodes: DataFrame, graph: str, mix: list, edge_values: list, scaler: list, clamp: float | None = 5.0, head: str = "head") -> DataFrame:
    """GRA-07: graph, node, head, degree and out (array) of every node and head; a node without incoming edges has zeros.

    By softmax over the incoming edges, the values of the sources and the scores of the edges are averaged; the latter go through edge_values
    (head: output channel: weights) and are added. scaler (head: channel: two numbers) then weighs each channel and
    its product with log(1 + incoming edges)."""
    width = len(mix[0])
    scored = edge_scores(edges, nodes, graph, mix, clamp, head)
    # a row without a logit for every node, so that those without edges come out of the same aggregate
    empty = nodes.select(graph, F.col("node").alias("dst"), head, F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("array<double>").alias("score"), F.lit(None).cast("double").alias("logit"))
    mixed = segment_mix(scored.drop("src").unionByName(empty), [graph, "dst", head], F.col("logit"), {"v": width, "score": width}, clamp is not None, "degree")
    whole = mixed.withColumn("_h", F.zip_with("v", project(F.col("score"), of_head(edge_values, head)), lambda a, b: a + b))
    scaled = F.transform("_h", lambda x, i: x * F.get(F.get(of_head(scaler, head), i), F.lit(0)) + x * F.log1p("degree") * F.get(F.get(of_head(scaler, head), i), F.lit(1)))
    return whole.select(graph, F.col("dst").alias("node"), head, "degree", scaled.alias("out"))


def attention_pool(nodes: DataFrame, graph: str, gate: Column, values: str, width: int, head: str = "head") -> DataFrame:
    """GRA-07, AGG-21: graph, head and the mean of values (array) of its nodes, weighted by the softmax of gate; gates have no bound."""
    return segment_mix(nodes, [graph, head], gate, {values: width}, bounded=False)


def joined_heads(df: DataFrame, keys: list[str], values: str, n: int, head: str = "head") -> DataFrame:
    """keys and values: the arrays of the n heads of each key one after another (n rows a key)."""
    by_head = [F.max(F.when(F.col(head) == h, F.col(values))).alias(f"_{h}") for h in range(n)]
    return df.groupBy(*keys).agg(*by_head).select(*keys, reduce(F.concat, [F.col(f"_{h}") for h in range(n)]).alias(values))
