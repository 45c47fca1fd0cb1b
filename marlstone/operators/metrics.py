"""Metrics and losses as mergeable aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.keys import finite
from .ragged import running_counts


@dataclass(frozen=True)
class Metric:
    """EXT-03: a masked mean that merges: partial sums and counts per batch, merged by sums, finished at the end.

    value(y, p) is a column; rows where it is null are masked (FIL-08)."""

    name: str
    value: Callable[[Column, Column], Column]

    def partial(self, df: DataFrame, keys: list[str], y: Column, p: Column) -> DataFrame:
        v = self.value(y, p)
        return df.groupBy(*keys).agg(F.sum(v).alias("total"), F.count(v).alias("n"))

    @staticmethod
    def merge(partials: DataFrame, keys: list[str]) -> DataFrame:
        return partials.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    @staticmethod
    def finish(merged: DataFrame) -> DataFrame:
        """0.0 where nothing was seen (AGG-13)."""
        return merged.withColumn("score", F.coalesce(F.try_divide("total", "n"), F.lit(0.0))).drop("total")

    def of(self, df: DataFrame, keys: list[str], y: Column, p: Column) -> DataFrame:
        return self.finish(self.partial(df, keys, y, p))


def logit_metric(f: Callable) -> Callable:
    return lambda y, x: f(y, x)


class Running:
    """EXT-03: a metric over batches: update with each, score at any time, reinit to start again.

    The state is a table of sums and counts by key; what is kept of a batch is as small as its keys."""

    def __init__(self, metric: Metric, keys: list[str]):
        self.metric, self.keys, self.state = metric, keys, None

    def update(self, batch: DataFrame, y: Column, p: Column) -> Running:
        new = self.metric.partial(batch, self.keys, y, p)
        self.state = new if self.state is None else self.metric.merge(self.state.unionByName(new), self.keys)
        return self

    def score(self) -> DataFrame:
        if self.state is None:
            raise ValueError("no batch yet")
        return self.metric.finish(self.state)

    def reinit(self) -> None:
        self.state = None


def scorer(name: str) -> Metric:
    """EXT-04: the metric of a name; ValueError for others."""
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[name]


#: EXT-01, EXT-04: name to metric.
METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("mae", numeric.l1),
        Metric("mse", numeric.l2),
        Metric("huber", numeric.huber),
        Metric("smooth_l1", numeric.smooth_l1),
        Metric("log_mae", lambda y, p: F.abs(y - numeric.signed_exp(p))),
        Metric("log_loss", lambda y, p: F.abs(numeric.log_target(y) - p)),
        Metric("bce", numeric.bce_with_logits),
        Metric("focal", numeric.focal),
        Metric("ordinal_bce", lambda y, x: numeric.ordinal_bce(y, x, 3)),
        Metric("ordinal_mae", lambda y, x: F.abs(y - numeric.ordinal_class(x, 3))),
    )
}


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """AGG-14: weighted mean of the finite values."""
    v = finite(F.col(value).cast("double"))
    w = F.when(v.isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias("mean"))


def mid_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Average ranks of ties. Equal values are counted first; counts are added up by ranges of the order, not by keys."""
    c = running_counts(df.groupBy(*keys, value).agg(F.count("*").alias("c")), keys, value, ["c"])
    ranks = c.withColumn(name, F.col("upto_c") - (F.col("c") - 1) / 2.0).drop("c", "upto_c")
    return df.join(ranks, [*keys, value])


def auroc(df: DataFrame, keys: list[str], y: str, score: str, least: int = 1) -> DataFrame:
    """AGG-15, AGG-17: area under the ROC curve by mid-ranks; null with fewer than least positives or negatives."""
    seen = df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
    c = seen.groupBy(*keys, score).agg(F.count("*").alias("c"), F.count_if(F.col(y) == 1).alias("pos"))
    ranked = running_counts(c, keys, score, ["c"]).withColumn("rank", F.col("upto_c") - (F.col("c") - 1) / 2.0)
    s = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("c").cast("double").alias("n"))
    neg = F.col("n") - F.col("p")
    area = (F.col("r") - F.col("p") * (F.col("p") + 1.0) / 2.0) / (F.col("p") * neg)
    return s.select(*keys, F.when((F.col("p") >= least) & (neg >= least), area).alias("auroc"))


def mean_auroc(df: DataFrame, keys: list[str], y: str, score: str, least: int = 1) -> DataFrame:
    """AGG-15: mean over the tasks that can be scored, 0.0 without any."""
    return auroc(df, keys, y, score, least).agg(F.coalesce(F.avg("auroc"), F.lit(0.0)).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """AGG-17: sum over thresholds of precision times the gain in recall; ties are one threshold."""
    c = df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("c"), F.count_if(F.col(y) == 1).alias("pos"))
    step = running_counts(c, keys, F.desc(score), ["pos", "c"]).select(*keys, "pos", F.col("upto_pos").alias("tp"), F.col("upto_c").alias("k"))
    s = step.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / F.col("k")).alias("s"), F.sum("pos").alias("p"))
    return s.select(*keys, F.try_divide("s", "p").alias("average_precision"))


def correlations(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """AGG-17: Pearson, and Spearman as Pearson of mid-ranks."""
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    ranked = mid_ranks(mid_ranks(both, keys, y, "_ry"), keys, p, "_rp")
    return ranked.groupBy(*keys).agg(F.corr(y, p).alias("pearson"), F.corr("_ry", "_rp").alias("spearman"))


def regression_report(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """AGG-18: r2, MAE, MSE, explained variance in one pass."""
    e = F.col(y) - F.col(p)
    own = F.when(e.isNotNull(), F.col(y))
    return df.groupBy(*keys).agg(
        (1.0 - F.try_divide(F.sum(e * e), F.var_pop(own) * F.count(own))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        (1.0 - F.try_divide(F.var_pop(e), F.var_pop(own))).alias("explained_variance"),
    )


def flagged_rmse(df: DataFrame, keys: list[str], error: Column, flag: Column) -> DataFrame:
    """AGG-16, MAP-03, T14: RMSE overall, of flagged and of other rows, and both differences."""
    r = lambda c: F.sqrt(F.avg(F.when(c, error * error)))
    g = df.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("overall_rmse"), r(flag).alias("cliff_rmse"), r(~flag).alias("noncliff_rmse"))
    return g.withColumn("cliff_delta_rmse", F.col("cliff_rmse") - F.col("overall_rmse")).withColumn("delta", F.col("cliff_rmse") - F.col("noncliff_rmse"))


def per_graph_mean(df: DataFrame, graph: str, error2: Column) -> DataFrame:
    """T17: mean over all graphs of the mean squared error of their unmasked rows; graphs without any count as 0."""
    g = df.groupBy(graph).agg(F.coalesce(F.avg(error2), F.lit(0.0)).alias("loss"))
    return g.agg(F.avg("loss").alias("loss"), F.count("*").alias("graphs"))


def ensemble(df: DataFrame, key: str, p: str, cut: float = 0.5) -> DataFrame:
    """AGG-25: mean prediction and whether it exceeds cut."""
    return df.groupBy(key).agg(F.avg(p).alias("p")).withColumn("label", (F.col("p") > cut).cast("int"))


#: Coefficients of Lanczos' approximation of log gamma (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """MTH-04: log gamma of positive x in built-in expressions."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + float(k))
    t = z + 7.5
    return 0.91893853320467274178 + (z + 0.5) * F.log(t) - t + F.log(total)


def beta_nll(df: DataFrame, y: str, a: str, b: str, name: str = "nll") -> DataFrame:
    """MTH-04: negative log density of Beta(a, b) at y; null outside its domain."""
    t, p, q = (F.col(c).cast("double") for c in (y, a, b))
    density = log_gamma(p) + log_gamma(q) - log_gamma(p + q) - (p - 1.0) * F.log(t) - (q - 1.0) * F.log(1.0 - t)
    return df.withColumn(name, F.when((t > 0) & (t < 1) & (p > 0) & (q > 0), density))
