"""Task weights of multi-task training as columns over (step, task, loss)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .compare import step_ratio_weights


def _softmax(df: DataFrame, step: str, x: Column) -> DataFrame:
    """Weights of one step's tasks; tasks of a step are few."""
    w = W.partitionBy(step)
    e = df.withColumn("_x", x).withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_x", "_e")


def equal(df: DataFrame, step: str, task: str, loss: str) -> DataFrame:
    """MTH-12: one over the number of tasks."""
    return df.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy(step)))


def random(df: DataFrame, step: str, task: str, loss: str, seed: int = 0) -> DataFrame:
    """MTH-12, T24: softmax of standard normals that depend on seed, step and task only (Box-Muller of two hashes)."""
    from ..functions.keys import hash32

    u = lambda i: (hash32(F.col(step), F.lit("/"), F.col(task), F.lit(f"/{seed}/{i}")) + 0.5) / F.lit(4294967296.0)
    return _softmax(df, step, F.sqrt(-2.0 * F.log(u(0))) * F.cos(F.lit(6.283185307179586) * u(1)))


def uncertainty(df: DataFrame, step: str, task: str, loss: str, scale: str = "scale") -> DataFrame:
    """MTH-12: share of the precision 1 / (2 exp(scale)); objective is the step's weighted loss plus half the scales."""
    precision = 1.0 / (2.0 * F.exp(scale))
    w = W.partitionBy(step)
    p = df.withColumn("_p", precision).withColumn("weight", F.col("_p") / F.sum("_p").over(w))
    return p.withColumn("objective", F.sum(F.col(loss) * F.col("_p") + F.col(scale) / 2.0).over(w)).drop("_p")


def chebyshev(df: DataFrame, step: str, task: str, loss: str, nadir: str = "nadir", mu: float = 1.0, eps: float = 1e-10) -> DataFrame:
    """MTH-12, STM-05: smooth maximum of the log ratios to the nadir: softmax of them over mu; objective is
    mu logsumexp(shifted / mu) times the number of tasks."""
    w = W.partitionBy(step)
    r = df.withColumn("_r", F.log(F.col(loss) / F.col(nadir) + eps)).withColumn("_z", (F.col("_r") - F.max("_r").over(w)) / mu)
    total = F.sum(F.exp("_z")).over(w)
    out = r.withColumn("weight", F.exp("_z") / total).withColumn("objective", mu * F.log(total) * F.count("*").over(w))
    return out.drop("_r", "_z")


def ramped(position: Column, steps: int, start: float, end: float) -> Column:
    """WIN-16: linear from start to end over steps, held outside; at once if there is one step."""
    part = F.lit(1.0) if steps == 1 else F.least(F.greatest(position / F.lit(float(steps - 1)), F.lit(0.0)), F.lit(1.0))
    return start - (start - end) * part


#: EXT-02: name to weighting; see weighting.
WEIGHTINGS: dict[str, Callable] = {"equal": equal, "random": random, "uncertainty": uncertainty, "step_ratio": lambda df, step, task, loss, temperature=2.0: step_ratio_weights(df, task, step, loss, temperature), "chebyshev": chebyshev}


def weighting(name: str) -> Callable:
    """EXT-02: the weighting of a name; ValueError for others."""
    if name not in WEIGHTINGS:
        raise ValueError(f"unknown weighting: {name}")
    return WEIGHTINGS[name]
