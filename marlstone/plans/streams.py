"""Queries over event series: folds, step weights, streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as K
from ..operators import weighting
from ..sources.tables import table
from ..streaming import incremental as S
from .registry import query


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value of each event type and day."""
    e = table(spark, sf, "events", ["ts", "event_type", "value"])
    return e.groupBy(F.col("event_type").alias("task"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))


_DAYS = "d AS (SELECT event_type AS task, ts::DATE AS day, round(avg(value), 6) AS loss FROM events GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_DAYS}, o AS (SELECT task, loss, row_number() OVER (PARTITION BY task ORDER BY day) AS i FROM d),
r AS (SELECT task, i, loss AS ema FROM o WHERE i = 1 UNION ALL SELECT o.task, o.i, 0.9::DOUBLE * r.ema + (1 - 0.9::DOUBLE) * o.loss FROM r JOIN o ON o.task = r.task AND o.i = r.i + 1)
SELECT task, round(arg_max(ema, i), 9) AS ema FROM r GROUP BY task""")
def ema_fold(spark, sf):
    """AGG-30."""
    return K.ema_by_group(_days(spark, sf), "task", ["day"], "loss", 0.9).select("task", F.round("ema", 9).alias("ema"))


@query(f"""WITH {_DAYS}, r AS (SELECT *, coalesce(loss / lag(loss) OVER (PARTITION BY task ORDER BY day), 1.0) / 2.0 AS r FROM d)
SELECT task, day::VARCHAR AS day, round(count(*) OVER (PARTITION BY day) * exp(r) / sum(exp(r)) OVER (PARTITION BY day), 8) AS weight FROM r""")
def dwa_weights(spark, sf):
    """WIN-14, MTH-12."""
    return K.step_ratio_weights(_days(spark, sf), "task", "day", "loss", 2.0).select("task", F.col("day").cast("string").alias("day"), F.round("weight", 8).alias("weight"))


@query(f"WITH {_DAYS} SELECT task, day::VARCHAR AS day, round(avg(loss) OVER (PARTITION BY task ORDER BY day), 10) AS running, min(loss) OVER (PARTITION BY task ORDER BY day) AS nadir FROM d")
def running_weight_avg(spark, sf):
    """AGG-29."""
    r = K.running_minimum(K.running_average(_days(spark, sf), "task", "day", "loss"), "task", "day", "loss")
    return r.select("task", F.col("day").cast("string").alias("day"), F.round("running", 10).alias("running"), "nadir")


_STEPS = "s AS (SELECT DISTINCT l_partkey AS step FROM lineitem), l AS (SELECT max(step) AS last FROM s)"


@query(f"""WITH {_STEPS} SELECT policy, step FROM s, l, (VALUES ('every 50 after 60', 50, 60), ('all after 90', 0, 90), ('latest', -1, 0), ('every 20', 20, 0)) AS p(policy, every, warmup)
WHERE step = last OR (step >= warmup AND (every = 0 OR (every > 0 AND step % CASE WHEN every > 0 THEN every ELSE 1 END = 0)))""")
def checkpoint_retention(spark, sf):
    """SNK-17, SRT-09: warm-up, every so many-th, all and latest only."""
    steps = table(spark, sf, "lineitem", ["l_partkey"]).select(F.col("l_partkey").alias("step")).distinct()
    one = lambda policy, every, warmup: K.retained(steps, "step", every, warmup).select(F.lit(policy).alias("policy"), "step")
    return one("every 50 after 60", 50, 60).union(one("all after 90", 0, 90)).union(one("latest", -1, 0)).union(one("every 20", 20, 0))


@query("SELECT event_type, round(sum(value), 4) AS total, count(value)::BIGINT AS n FROM events GROUP BY event_type")
def stream_incremental_metric(spark, sf):
    """STM-01, STM-02, STM-03."""
    stream = S.file_stream(spark, f"{sf}/events.parquet")
    out = S.run_to_end(S.masked_totals(stream, ["event_type"], F.col("value")), ["event_type"])
    return out.select("event_type", F.round("total", 4).alias("total"), "n")


@query("SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf):
    """STM-02, T19: event-time windows."""
    stream = S.file_stream(spark, f"{sf}/events.parquet")
    out = S.run_to_end(S.windowed_totals(stream, "ts", "1 day", "1 day", ["event_type"], F.col("value")), ["w", "event_type"])
    return out.select(F.col("w.start").cast("long").alias("start"), "event_type", "n")


@query(f"WITH {_DAYS} SELECT task, day::VARCHAR AS day, round(1.0::DOUBLE / count(*) OVER (PARTITION BY day), 9) AS weight FROM d")
def equal_weights(spark, sf):
    """MTH-12, EXT-02."""
    w = weighting.WEIGHTINGS["equal"](_days(spark, sf), "day", "task", "loss")
    return w.select("task", F.col("day").cast("string").alias("day"), F.round("weight", 9).alias("weight"))


_U = "(('0x' || substr(md5(day::VARCHAR || '/' || task || '/3/{}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query(f"""WITH {_DAYS}, x AS (SELECT task, day, sqrt(-2.0::DOUBLE * ln({_U.format(0)})) * cos(6.283185307179586::DOUBLE * ({_U.format(1)})) AS x FROM d)
SELECT task, day::VARCHAR AS day, round(exp(x) / sum(exp(x)) OVER (PARTITION BY day), 8) AS weight FROM x""")
def random_weights(spark, sf):
    """MTH-12, EXT-02, T24."""
    w = weighting.random(_days(spark, sf), "day", "task", "loss", 3)
    return w.select("task", F.col("day").cast("string").alias("day"), F.round("weight", 8).alias("weight"))


@query(f"""WITH {_DAYS}, s AS (SELECT *, -0.5::DOUBLE + len(task) / 10.0::DOUBLE AS scale FROM d), p AS (SELECT *, 1 / (2 * exp(scale)) AS p FROM s)
SELECT task, day::VARCHAR AS day, round(p / sum(p) OVER (PARTITION BY day), 9) AS weight, round(sum(loss * p + scale / 2) OVER (PARTITION BY day), 7) AS objective FROM p""")
def uncertainty_weights(spark, sf):
    """MTH-12, EXT-02."""
    d = _days(spark, sf).withColumn("scale", -0.5 + F.length("task") / 10.0)
    w = weighting.uncertainty(d, "day", "task", "loss")
    return w.select("task", F.col("day").cast("string").alias("day"), F.round("weight", 9).alias("weight"), F.round("objective", 7).alias("objective"))


@query(f"""WITH {_DAYS}, n AS (SELECT *, min(loss) OVER (PARTITION BY task ORDER BY day) AS nadir FROM d), r AS (SELECT *, ln(loss / nadir + 1e-10) AS r FROM n),
z AS (SELECT *, (r - max(r) OVER (PARTITION BY day)) / 0.5::DOUBLE AS z FROM r)
SELECT task, day::VARCHAR AS day, round(exp(z) / sum(exp(z)) OVER (PARTITION BY day), 8) AS weight, round(0.5::DOUBLE * ln(sum(exp(z)) OVER (PARTITION BY day)) * count(*) OVER (PARTITION BY day), 8) AS objective FROM z""")
def chebyshev_weights(spark, sf):
    """MTH-12, EXT-02, AGG-29."""
    d = K.running_minimum(_days(spark, sf), "task", "day", "loss")
    w = weighting.chebyshev(d, "day", "task", "loss", mu=0.5)
    return w.select("task", F.col("day").cast("string").alias("day"), F.round("weight", 8).alias("weight"), F.round("objective", 8).alias("objective"))
