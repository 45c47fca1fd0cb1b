"""Comparison of methods over tasks and seeds: aggregation, ranks, wins, corrections, tables.

Facts are long: method, seed, task, metric, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ragged import running_counts


def valid_facts(facts: DataFrame) -> DataFrame:
    """FIL-06, FIL-07: without missing values and without seeds or methods that are metadata (leading underscore)."""
    meta = lambda c: F.col(c).cast("string").startswith("_")
    return facts.where(F.col("value").isNotNull() & ~F.isnan("value") & ~meta("seed") & ~meta("method"))


def seed_aggregate(facts: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-06, T10: mean and sample deviation (0.0 for one seed) over seeds, with their number."""
    return facts.groupBy(*keys).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n"))


def with_summary(facts: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-13: facts and, under the seed _summary, mean and deviation of each metric over seeds (as metric_mean, metric_std),
    which readers leave out as metadata."""
    agg = seed_aggregate(valid_facts(facts), [*keys, "metric"])
    both = F.explode(F.array(F.struct(F.concat("metric", F.lit("_mean")).alias("m"), F.col("mean").alias("v")), F.struct(F.concat("metric", F.lit("_std")).alias("m"), F.col("std").alias("v"))))
    extra = agg.select(*keys, both.alias("x")).select(*keys, F.lit("_summary").alias("seed"), F.col("x.m").alias("metric"), F.col("x.v").alias("value"))
    return facts.select(*keys, F.col("seed").cast("string").alias("seed"), "metric", "value").unionByName(extra)


def seed_values(facts: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-07: values in order of seed; one per seed, so lists stay short."""
    listed = facts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seed", "value"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["value"]).alias("values"))


def oriented(value: Column, higher_is_better: Column) -> Column:
    """Best is largest."""
    return F.when(higher_is_better, value).otherwise(-value)


def competition_rank(scores: DataFrame, task: str, good: Column) -> DataFrame:
    """WIN-03, T8: 1 + the number of strictly better methods of the task."""
    return scores.withColumn("rank", F.rank().over(W.partitionBy(task).orderBy(F.desc(good))).cast("long"))


def ordinal_rank(scores: DataFrame, task: str, good: Column, ties: list[str]) -> DataFrame:
    """WIN-04, T8: place in the sorted list; ties in order of the given columns (own methods first)."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(task).orderBy(F.desc(good), *ties)).cast("long"))


def mean_rank(ranked: DataFrame, method: str = "method") -> DataFrame:
    """AGG-26."""
    return ranked.groupBy(method).agg(F.avg("rank").alias("mean_rank"), F.count("rank").alias("n_tasks"))


def best_with_tolerance(scores: DataFrame, task: str, good: Column, tolerance: float = 0.001) -> DataFrame:
    """WIN-12, T11: is_best: within the relative tolerance of the task's best."""
    g = scores.withColumn("_g", good)
    top = g.groupBy(task).agg(F.max("_g").alias("_top"))
    return g.join(top, task).withColumn("is_best", F.abs(F.col("_g") - F.col("_top")) <= F.abs(F.col("_top")) * tolerance).drop("_g", "_top")


def win_percent(scores: DataFrame, task: str, good: Column, own: Column | None = None, tolerance: float = 0.001) -> DataFrame:
    """AGG-11: share of all tasks that each method wins: among the best with the relative tolerance, or with own (a
    boolean) each own method no worse than the best of the others by more than it (wins if there is none).
    A task that a method lacks counts as not won; n_tasks is the number of all tasks."""
    g = scores.withColumn("_g", good).withColumn("_own", F.lit(True) if own is None else own)
    n = scores.agg(F.countDistinct(task).alias("n_tasks"))  # one row
    if own is None:
        won = F.abs(F.col("_g") - F.col("_top")) <= F.abs("_top") * tolerance
        top = g.groupBy(task).agg(F.max("_g").alias("_top"))
    else:
        won = F.col("_top").isNull() | (F.col("_g") >= F.col("_top") - F.abs("_top") * tolerance)
        top = g.where(~F.col("_own")).groupBy(task).agg(F.max("_g").alias("_top"))
    wins = g.where("_own").join(top, task, "left").groupBy("method").agg(F.count_if(won).alias("_wins"))
    return wins.crossJoin(F.broadcast(n)).select("method", (100.0 * F.col("_wins") / F.col("n_tasks")).alias("win_percent"), "n_tasks")


def significant(tests: DataFrame, correction: str = "none", p: str = "p", alpha: float = 0.05) -> DataFrame:
    """AGG-12, T15: adds rejected over the pairs of all tasks together: "bh", "bonferroni" or "none"; a missing p is not significant."""
    if correction == "bh":
        return benjamini_hochberg(tests, p, alpha)
    if correction == "bonferroni":
        return bonferroni(tests, p, alpha)
    if correction != "none":
        raise ValueError(f"unknown correction: {correction}")
    return tests.withColumn("rejected", F.coalesce(F.col(p) < alpha, F.lit(False)))


def scaled_errors(facts: DataFrame, scales: DataFrame, higher: Column, task: str = "task") -> DataFrame:
    """AGG-12, MTH-09: adds higher; values of tasks with a scale become 1 - value / scale, where higher is better."""
    joined = facts.join(scales.select(task, F.col("scale").cast("double").alias("_s")), task, "left").withColumn("higher", higher | F.col("_s").isNotNull())
    return joined.withColumn("value", F.when(F.col("_s").isNull(), F.col("value")).otherwise(1.0 - F.col("value") / F.col("_s"))).drop("_s")


def benjamini_hochberg(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """WIN-05, T15: rejected by the step-up rule over all tests: p at most the largest p_(k) <= k alpha / n.

    Only counts by distinct p up to alpha are put in order, by ranges."""
    seen = tests.where(F.col(p).isNotNull())
    n = seen.agg(F.count("*").alias("n"))
    steps = seen.where(F.col(p) <= alpha).groupBy(p).agg(F.count("*").alias("c"))
    ranked = running_counts(steps, [], p, ["c"]).withColumnRenamed("upto_c", "k")
    cut = ranked.crossJoin(F.broadcast(n)).where(F.col(p) <= F.col("k") / F.col("n") * alpha).agg(F.max(p).alias("_cut"))
    return tests.crossJoin(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """WIN-05, T15: strict, over the number of tests."""
    n = tests.agg(F.count(p).alias("_n"))  # one row
    return tests.crossJoin(F.broadcast(n)).withColumn("rejected", F.coalesce(F.col(p) < alpha / F.col("_n"), F.lit(False))).drop("_n")


def summary(facts: DataFrame, task: str = "task", least: int = 2) -> DataFrame:
    """FIL-16: mean, variance and size of each method and task with at least least seeds."""
    return facts.groupBy(task, "method").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count("value").alias("n")).where(F.col("n") >= least)


def method_pairs(s: DataFrame, task: str = "task") -> DataFrame:
    """JOI-10: all pairs of methods of a task, a < b by name; methods of one task are few."""
    left = s.select(task, *[F.col(c).alias(f"{c}_a") for c in ("method", "mean", "var", "n")])
    right = s.select(task, *[F.col(c).alias(f"{c}_b") for c in ("method", "mean", "var", "n")])
    return left.join(right, task).where("method_a < method_b")


def welch(pairs: DataFrame) -> DataFrame:
    """MTH-10: t statistic and degrees of freedom of unequal variances, null for zero variance."""
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return pairs.withColumn("t", t).withColumn("df", df)


def pooled(s: DataFrame, task: str = "task") -> DataFrame:
    """MTH-10: within-task pooled variance, degrees of freedom and number of methods."""
    return s.groupBy(task).agg((F.sum(F.col("var") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("pooled_var"), F.sum(F.col("n") - 1).alias("pooled_df"), F.count("*").alias("k"))


def studentised_range(pairs: DataFrame, pool: DataFrame | None, task: str = "task") -> DataFrame:
    """MTH-10: q and df of Tukey-Kramer with a pooled variance, of Games-Howell without (sizes k from pool or pairs)."""
    diff = F.abs(F.col("mean_a") - F.col("mean_b"))
    if pool is not None:
        p = pairs.join(pool, task)
        return p.withColumn("q", F.try_divide(diff, F.sqrt(F.col("pooled_var") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b"))))).withColumn("q_df", F.col("pooled_df").cast("double"))
    w = welch(pairs)
    return w.withColumn("q", F.abs("t") * F.sqrt(F.lit(2.0))).withColumn("q_df", F.col("df"))


def _better_first(tested: DataFrame, higher: Column) -> DataFrame:
    """tested with better, worse and rejected; of equal means the first name is the better."""
    a_first = F.when(higher, F.col("mean_a") >= F.col("mean_b")).otherwise(F.col("mean_a") <= F.col("mean_b"))
    name = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    return tested.withColumn("better", name("method_a", "method_b")).withColumn("worse", name("method_b", "method_a"))


def pair_wins(tested: DataFrame, higher: Column) -> DataFrame:
    """AGG-12, WIN-15: method, other, wins, ties over all tasks, for each ordered pair with any: a significant
    difference is a win of the better, any other pair a tie of both."""
    sides = _better_first(tested, higher).select("better", "worse", "rejected").select(
        F.explode(F.array(F.struct(F.col("better").alias("method"), F.col("worse").alias("other"), F.col("rejected").alias("win"), (~F.col("rejected")).alias("tie")), F.struct(F.col("worse").alias("method"), F.col("better").alias("other"), F.lit(False).alias("win"), (~F.col("rejected")).alias("tie")))).alias("s")
    ).select("s.*")
    return sides.groupBy("method", "other").agg(F.count_if("win").alias("wins"), F.count_if("tie").alias("ties")).where("wins + ties > 0")


def top_ranks(tested: DataFrame, s: DataFrame, higher: Column, task: str = "task") -> DataFrame:
    """AGG-12, T21: participation (tasks with enough seeds, tested or not) and top_rank: tested tasks where the method is
    the best (the first name of equals) or not significantly different from the best. s: task, method, mean
    and whatever higher reads; methods of one task are few."""
    tied = s.select(task, "method", F.when(higher, F.col("mean")).otherwise(-F.col("mean")).alias("_g"))
    best = tied.groupBy(task).agg(F.min(F.struct((-F.col("_g")).alias("g"), "method")).alias("_b"), F.count("*").alias("_n")).where("_n > 1").select(task, F.col("_b.method").alias("_best"))
    apart = tested.where("rejected").select(task, F.explode(F.array(F.struct(F.col("method_a").alias("method"), F.col("method_b").alias("_best")), F.struct(F.col("method_b").alias("method"), F.col("method_a").alias("_best")))).alias("x")).select(task, "x.*").withColumn("_apart", F.lit(True))
    own = tied.join(best, task, "left").join(apart, [task, "method", "_best"], "left")
    return own.groupBy("method").agg(F.count("*").alias("participation"), F.count_if(F.col("_best").isNotNull() & F.col("_apart").isNull()).alias("top_rank"))


def common_tasks(facts: DataFrame, a: str, b: str, task: str = "task") -> DataFrame:
    """JOI-09, SET-04: tasks that both methods have."""
    one = lambda m: facts.where(F.col("method") == m).select(task)
    return one(a).intersect(one(b))


def mean_of_means(agg: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-10: mean of means and mean of deviations across tasks."""
    return agg.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def tasks_by_best(agg: DataFrame, task: str, value: str) -> DataFrame:
    """AGG-27: tasks in order of their least value."""
    return agg.groupBy(task).agg(F.min(value).alias("best")).orderBy("best", task)


def priority_sort(methods: DataFrame, order: list[str], method: str = "method") -> DataFrame:
    """SRT-04: adds the place of the first name of order that the method contains, their number if none."""
    cases = [F.when(F.contains(F.col(method), F.lit(o)), F.lit(i)) for i, o in enumerate(order)]
    return methods.withColumn("priority", F.coalesce(*cases, F.lit(len(order))).cast("long"))


def exclude_methods(facts: DataFrame, names: list[str]) -> DataFrame:
    """FIL-11: without regard to case."""
    return facts.where(~F.lower("method").isin([n.lower() for n in names]))


def markdown(df: DataFrame, row: str, column: str, cell: str) -> str:
    """SNK-14: a small result as a Markdown table, rows and columns in order of name."""
    wide = df.groupBy(row).pivot(column).agg(F.first(cell)).orderBy(row)
    lines = ["| " + " | ".join(wide.columns) + " |", "|" + "---|" * len(wide.columns)]
    lines += ["| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in wide.collect()]
    return "\n".join(lines) + "\n"


def step_ratio_weights(losses: DataFrame, task: str, step: str, loss: str, temperature: float) -> DataFrame:
    """WIN-14, MTH-12: T softmax(r / temperature) of each task's loss ratio to the step before; equal weights at first."""
    r = F.col(loss) / F.lag(loss).over(W.partitionBy(task).orderBy(step))
    rated = losses.withColumn("_r", F.coalesce(r, F.lit(1.0)) / temperature)
    w = W.partitionBy(step)
    e = rated.withColumn("_e", F.exp(F.col("_r") - F.max("_r").over(w)))
    return e.withColumn("weight", F.count("*").over(w) * F.col("_e") / F.sum("_e").over(w)).drop("_r", "_e")


def running_average(df: DataFrame, task: str, step: str, value: str) -> DataFrame:
    """AGG-29: average up to each step."""
    return df.withColumn("running", F.avg(value).over(W.partitionBy(task).orderBy(step).rowsBetween(W.unboundedPreceding, 0)))


def running_minimum(df: DataFrame, task: str, step: str, value: str) -> DataFrame:
    """AGG-29, STM-05: least value so far (nadir)."""
    return df.withColumn("nadir", F.min(value).over(W.partitionBy(task).orderBy(step).rowsBetween(W.unboundedPreceding, 0)))


def ema_by_group(df: DataFrame, group: str, order: list[str], value: str, decay: float) -> DataFrame:
    """AGG-30: exponential moving average of each group's ordered values; groups are series of steps."""
    from ..functions.numeric import ema

    listed = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("_l"))
    return listed.select(group, ema(F.transform("_l", lambda x: x[value]), decay).alias("ema"))


def retained(checkpoints: DataFrame, step: str, every: int, warmup: int = 0) -> DataFrame:
    """SNK-17, SRT-09: the latest checkpoint, and of the older ones, from step warmup on, all (every = 0), those of every so
    many-th step (every > 0) or none (every < 0)."""
    last = checkpoints.agg(F.max(step).alias("_last"))  # one row
    older = F.lit(every == 0) if every <= 0 else F.col(step) % every == 0
    kept = (F.col(step) == F.col("_last")) | (older & (F.col(step) >= warmup))
    return checkpoints.crossJoin(F.broadcast(last)).where(kept).drop("_last")
