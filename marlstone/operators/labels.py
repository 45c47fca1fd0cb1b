"""Quality control of sparse labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import running_counts

WIDE_LIMIT = 200  # columns up to which one wide aggregate compiles well


def _finish(n_valid: Column, n_pos: Column) -> Column:
    return F.when(n_valid == 0, 0.0).otherwise(n_pos / n_valid)


def melt(df: DataFrame, ids: list[str], tasks: list[str], name: str = "task", value: str = "y") -> DataFrame:
    """AGG-05: wide labels to (ids, task, y)."""
    return df.unpivot(ids, tasks, name, value)


def task_stats(long: DataFrame, task: str = "task", y: str = "y") -> DataFrame:
    """AGG-05: counts per task from long labels: scales to any number of tasks."""
    v = F.col(y).cast("double")
    out = long.groupBy(task).agg(F.count("*").alias("n"), F.count_if(v == 1.0).alias("n_pos"), F.count_if(v == 0.0).alias("n_neg"))
    n_valid = F.col("n_pos") + F.col("n_neg")
    return out.select(task, n_valid.alias("n_valid"), "n_pos", "n_neg", (F.col("n") - n_valid).alias("n_nan"), _finish(n_valid, F.col("n_pos")).alias("pos_frac"))


def task_stats_wide(df: DataFrame, tasks: list[str]) -> DataFrame:
    """AGG-05: the same from wide labels in one scan without a shuffle of rows; above WIDE_LIMIT columns it melts."""
    if len(tasks) > WIDE_LIMIT:
        return task_stats(melt(df, [], tasks))
    one = lambda c, v: F.count_if(F.col(f"`{c}`").cast("double") == v)
    row = df.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(c).alias("task"), one(c, 1.0).alias("n_pos"), one(c, 0.0).alias("n_neg")) for c in tasks]).alias("s"))
    flat = row.select("n", F.explode("s").alias("s")).select("n", "s.task", "s.n_pos", "s.n_neg")
    n_valid = F.col("n_pos") + F.col("n_neg")
    return flat.select("task", n_valid.alias("n_valid"), "n_pos", "n_neg", (F.col("n") - n_valid).alias("n_nan"), _finish(n_valid, F.col("n_pos")).alias("pos_frac"))


def drop_reason(min_pos: int, min_neg: int, min_valid: int) -> Column:
    """FIL-05: which thresholds fail, joined by ';', null if none."""
    fails = [F.when(F.col(c) < m, F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit(f"<{m}"))) for c, m in (("n_pos", min_pos), ("n_neg", min_neg), ("n_valid", min_valid))]
    return F.nullif(F.concat_ws(";", *fails), F.lit(""))


def filter_tasks(stats: DataFrame, min_pos: int, min_neg: int, min_valid: int, least_kept: int = 0) -> DataFrame:
    """FIL-05, SNK-04: adds drop_reason and kept; with least_kept, fails if fewer tasks are kept."""
    out = stats.withColumn("drop_reason", drop_reason(min_pos, min_neg, min_valid)).withColumn("kept", F.col("drop_reason").isNull())
    if least_kept and out.where("kept").count() < least_kept:
        raise ValueError(f"fewer than {least_kept} tasks pass the thresholds")
    return out


def reason_histogram(filtered: DataFrame) -> DataFrame:
    """AGG-09: how often each threshold failed."""
    parts = filtered.where("drop_reason is not null").select(F.explode(F.split("drop_reason", ";")).alias("r"))
    return parts.groupBy(F.substring_index("r", "=", 1).alias("reason")).agg(F.count("*").alias("n"))


def floor_quantiles(df: DataFrame, group: str, value: str, quantiles: list[float]) -> DataFrame:
    """AGG-08, T9: sorted[int(p (n - 1))] per group, with least and most.

    Values are first counted; the counts are added up by ranges of the order, so a group may hold any share of the rows."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = running_counts(c, [group], value, ["c"]).withColumnRenamed("upto_c", "upto")
    n = c.groupBy(group).agg(F.sum("c").alias("n"))
    ranked = ranked.join(n, group)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.col(value)))
    return ranked.groupBy(group).agg(F.min(value).alias("least"), *[at(p).alias(f"q{round(100 * p)}") for p in quantiles], F.max(value).alias("most"))


#: Folds by the number of rows: 3 above 2,000, 5 from 250, 3 below.
FOLDS_BY_ROWS = ((2000, 3), (249, 5), (-1, 3))


def adaptive_folds(df: DataFrame, task: str, y: str, classes: bool = True) -> DataFrame:
    """AGG-24: rows of each task, size of its smallest class (0 if a class 0 .. largest is absent) and folds: by the
    number of rows, and for classes no more than the smallest class has and no fewer than 2."""
    per = df.where(F.col(y).isNotNull()).groupBy(task, F.col(y).cast("int").alias("_y")).agg(F.count("*").alias("c"))
    out = per.groupBy(task).agg(F.sum("c").alias("n"), F.when(F.count("*") > F.max("_y"), F.min("c")).otherwise(0).cast("long").alias("min_class"))
    folds = F.coalesce(*[F.when(F.col("n") > least, k) for least, k in FOLDS_BY_ROWS])
    return out.withColumn("folds", (F.greatest(F.lit(2), F.least(folds, "min_class")) if classes else folds).cast("long"))


def valid_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-33: non-missing values of each column, one row."""
    return df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
