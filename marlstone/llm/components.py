"""Connected components of an edge table by alternating large and small stars.

Each round joins every edge with the least neighbour of one end and keeps the new, shorter
edges; after a number of rounds logarithmic in the longest path every node hangs on the least node
of its component. Edges are written to the shared store after each round. Self-loops, repeated
edges, nulls and empty tables are allowed; nodes of null are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node is either a root or the child of one root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("child")), F.struct(F.col("b").alias("x"), F.lit(0).alias("child")))).alias("e")).select("e.*")
    roles = ends.groupBy("x").agg(F.sum("child").alias("n"), F.min("child").alias("low"))
    return roles.where("n > 1 or n = 1 and low = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node but the roots; edges: a, b."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    current = materialize(_small(edges).distinct())
    while not _is_forest_of_stars(current):
        new = materialize(_small(_large(current).distinct()).distinct())
        drop(spark, current)
        current = new
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
