"""Queries that score predictions and compare methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, numeric
from ..operators import compare as K
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import significance
from ..sources import tables
from ..sources.tables import table
from .registry import query

H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


# ----------------------------------------------------------------- metrics
def _prices(spark: SparkSession, sf: str) -> DataFrame:
    """y: extended price, masked where the discount is 0; p: quantity times a constant."""
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice", "l_quantity", "l_discount"])
    return li.select(F.col("l_returnflag").alias("task"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("y"), (F.col("l_quantity") * 1500.0).alias("p"), (F.col("l_discount") > 0.05).alias("cliff"))


_PRICES = "x AS (SELECT l_returnflag AS task, CASE WHEN l_discount > 0 THEN l_extendedprice END AS y, l_quantity * 1500.0::DOUBLE AS p, l_discount > 0.05::DOUBLE AS cliff FROM lineitem)"


def _of(spark, sf, name: str, scale: float = 1.0, p=None) -> DataFrame:
    y, own = F.col("y") / scale, F.col("p") / scale if p is None else p
    return M.METRICS[name].of(_prices(spark, sf), ["task"], y, own).select("task", F.round("score", 6).alias("score"), "n")


def _sql(value: str) -> str:
    return f"WITH {_PRICES} SELECT task, round(coalesce(avg({value}), 0.0), 6) AS score, count({value})::BIGINT AS n FROM x GROUP BY task"


@query(_sql("abs(y - p)"))
def masked_mae(spark, sf):
    """AGG-13, MTH-03, FIL-08."""
    return _of(spark, sf, "mae")


@query(_sql("abs(y - sign(ln(1 + p)) * (exp(abs(ln(1 + p))) - 1))"))
def log_mae(spark, sf):
    """MTH-01, T26: the prediction is in log space."""
    return _of(spark, sf, "log_mae", p=F.log1p("p"))


@query(_sql("CASE WHEN abs(y - p) / 1e4 <= 1 THEN 0.5 * (y - p) * (y - p) / 1e8 ELSE abs(y - p) / 1e4 - 0.5 END"))
def huber(spark, sf):
    """MTH-03."""
    return _of(spark, sf, "huber", 1e4)


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    d = C.enrich(table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"]), table(spark, sf, "labels"), "doc_id")
    return d.withColumn("x", (F.col("n_chars") - 2000) / 4000.0)


_LOGITS = "x AS (SELECT doc_id, lang, source, n_chars, quality, toxic, (n_chars - 2000) / 4000.0::DOUBLE AS x FROM documents LEFT JOIN labels USING (doc_id))"
_SP = "(greatest({0}, 0.0) + ln(1 + exp(-abs({0}))))"


@query(f"""WITH {_LOGITS}, f AS (SELECT lang, toxic AS y, {_SP.format('x')} - x * toxic AS bce, CASE WHEN toxic = 1 THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(-x)) END AS pt FROM x)
SELECT lang, round(coalesce(avg(bce * pow(1 - pt, 2.0) * CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END), 0.0), 8) AS score, count(bce)::BIGINT AS n FROM f GROUP BY lang""")
def focal(spark, sf):
    """MTH-06."""
    out = M.METRICS["focal"].of(_logits(spark, sf), ["lang"], F.col("toxic").cast("double"), F.col("x"))
    return out.select("lang", F.round("score", 8).alias("score"), "n")


@query(f"""WITH {_LOGITS}, f AS (SELECT lang, {_SP.format('x')} - CASE WHEN quality + toxic > 0 THEN x ELSE 0 END + {_SP.format('(x - 1)')} - CASE WHEN quality + toxic > 1 THEN x - 1 ELSE 0 END AS v FROM x WHERE quality IS NOT NULL)
SELECT lang, round(avg(v), 8) AS score, count(*)::BIGINT AS n FROM f GROUP BY lang""")
def ordinal_bce(spark, sf):
    """MTH-05: three ordered classes."""
    d = _logits(spark, sf).where("quality is not null")
    out = M.METRICS["ordinal_bce"].of(d, ["lang"], F.col("quality") + F.col("toxic"), F.col("x"))
    return out.select("lang", F.round("score", 8).alias("score"), "n")


@query("""SELECT vec_id, round(lgamma(a) + lgamma(b) - lgamma(a + b) - (a - 1) * ln(y) - (b - 1) * ln(1 - y), 8) AS nll
FROM (SELECT vec_id, (label + 1) / 12.0::DOUBLE AS y, 1.5::DOUBLE + label AS a, 2.0::DOUBLE + vec_id % 5 AS b FROM embeddings)""")
def beta_nll(spark, sf):
    """MTH-04."""
    e = table(spark, sf, "embeddings", ["vec_id", "label"])
    d = e.select("vec_id", ((F.col("label") + 1) / 12.0).alias("y"), (1.5 + F.col("label")).alias("a"), (2.0 + F.col("vec_id") % 5).alias("b"))
    return M.beta_nll(d, "y", "a", "b").select("vec_id", F.round("nll", 8).alias("nll"))


@query("""WITH r AS (SELECT lang AS task, quality AS y, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS r FROM documents JOIN labels USING (doc_id)),
s AS (SELECT task, sum(CASE WHEN y = 1 THEN r ELSE 0 END)::DOUBLE AS r, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM r GROUP BY task)
SELECT task, CASE WHEN p >= 3 AND n - p >= 3 THEN round((r - p * (p + 1) / 2) / (p * (n - p)), 10) END AS auroc FROM s""")
def auroc_by_task(spark, sf):
    """AGG-15, UDA-04."""
    d = _logits(spark, sf).where("quality is not null").select(F.col("lang").alias("task"), "quality", "n_chars")
    return M.auroc(d, ["task"], "quality", "n_chars", 3).select("task", F.round("auroc", 10).alias("auroc"))


@query("""WITH c AS (SELECT lang AS task, n_chars, count(*) AS c, sum(quality) AS pos FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
w AS (SELECT task, pos, sum(pos) OVER (PARTITION BY task ORDER BY n_chars DESC) AS tp, sum(c) OVER (PARTITION BY task ORDER BY n_chars DESC) AS k FROM c)
SELECT task, round(sum(pos * tp::DOUBLE / k) / sum(pos), 10) AS average_precision FROM w GROUP BY task""")
def avg_precision(spark, sf):
    """AGG-17."""
    d = _logits(spark, sf).where("quality is not null").select(F.col("lang").alias("task"), "quality", "n_chars")
    return M.average_precision(d, ["task"], "quality", "n_chars").select("task", F.round("average_precision", 10).alias("average_precision"))


@query("""WITH r AS (SELECT l_returnflag AS task, l_extendedprice AS y, l_quantity AS p,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS ry,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rp FROM lineitem)
SELECT task, round(corr(y, p), 8) AS pearson, round(corr(ry, rp), 8) AS spearman FROM r GROUP BY task""")
def pearson_spearman(spark, sf):
    """AGG-17."""
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").cast("double").alias("p"))
    return M.correlations(d, ["task"], "y", "p").select("task", F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


@query(f"""WITH {_PRICES}, v AS (SELECT task, y, y - p AS e FROM x WHERE y IS NOT NULL)
SELECT task, round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 2) AS mse, round(1 - var_pop(e) / var_pop(y), 8) AS explained_variance FROM v GROUP BY task""")
def regression_report(spark, sf):
    """AGG-18."""
    r = M.regression_report(_prices(spark, sf), ["task"], "y", "p")
    return r.select("task", *[F.round(c, n).alias(c) for c, n in (("r2", 8), ("mae", 4), ("mse", 2), ("explained_variance", 8))])


@query(f"""WITH {_PRICES}, g AS (SELECT task, sqrt(avg((y - p) * (y - p))) AS o, sqrt(avg((y - p) * (y - p)) FILTER (WHERE cliff)) AS c, sqrt(avg((y - p) * (y - p)) FILTER (WHERE NOT cliff)) AS n FROM x GROUP BY task)
SELECT task, round(o, 5) AS overall_rmse, round(c, 5) AS cliff_rmse, round(n, 5) AS noncliff_rmse, round(c - o, 5) AS cliff_delta_rmse, round(c - n, 5) AS delta FROM g""")
def cliff_rmse(spark, sf):
    """AGG-16, MAP-03, T14."""
    r = M.flagged_rmse(_prices(spark, sf), ["task"], F.col("y") - F.col("p"), F.col("cliff"))
    return r.select("task", *[F.round(c, 5).alias(c) for c in r.columns[1:]])


@query("SELECT event_type, round(sum(value * weight) FILTER (WHERE isfinite(value)) / sum(weight) FILTER (WHERE isfinite(value)), 8) AS mean FROM (SELECT event_type, value, user_id % 7 + 1 AS weight FROM events) GROUP BY event_type")
def weighted_mean_finite(spark, sf):
    """AGG-14."""
    e = table(spark, sf, "events").withColumn("weight", F.col("user_id") % 7 + 1)
    return M.weighted_mean(e, ["event_type"], "value", "weight").select("event_type", F.round("mean", 8).alias("mean"))


@query("SELECT user_id, round(avg(p), 9) AS p, (round(avg(p), 9) > 0.5)::INTEGER AS label FROM (SELECT user_id, 1 / (1 + exp(-(value - 50) / 10)) AS p FROM events) GROUP BY user_id")
def ensemble_average(spark, sf):
    """AGG-25, MTH-02."""
    e = table(spark, sf, "events").select("user_id", numeric.sigmoid((F.col("value") - 50) / 10).alias("p"))
    out = M.ensemble(e, "user_id", "p").select("user_id", F.round("p", 9).alias("p"))
    return out.withColumn("label", (F.col("p") > 0.5).cast("int"))


@query("""SELECT vec_id, round(sign(x) * ln(1 + abs(x)), 9) AS signed_log, round(sign(x) * (exp(abs(x)) - 1), 9) AS signed_exp, round(CASE WHEN x + 1e-6 < 0 THEN -1 ELSE 1 END * ln(1 + abs(x) + 1e-6), 9) AS log_target,
  round(ln(q / (1 - q)), 6) AS logit, round(CASE WHEN abs(x) < 1 THEN 0.5 * x * x ELSE abs(x) - 0.5 END, 9) AS smooth, round(1 - abs(x) / 4, 9) AS scaled
FROM (SELECT vec_id, x, least(greatest(x, 1e-6), 1 - 1e-6) AS q FROM (SELECT vec_id, embedding[1]::DOUBLE * 3 AS x FROM embeddings))""")
def scalar_kernels(spark, sf):
    """MTH-01, MTH-02, MTH-03, MTH-09."""
    x = F.col("x")
    e = table(spark, sf, "embeddings", ["vec_id", "embedding"]).select("vec_id", (F.col("embedding")[0].cast("double") * 3).alias("x"))
    fields = {"signed_log": numeric.signed_log(x), "signed_exp": numeric.signed_exp(x), "log_target": numeric.log_target(x), "smooth": numeric.smooth_l1(x, F.lit(0.0)), "scaled": numeric.scaled_score(F.abs(x), F.lit(4.0))}
    return e.select("vec_id", *[F.round(c, 9).alias(n) for n, c in fields.items()], F.round(numeric.logit(x), 6).alias("logit"))


# ----------------------------------------------------------------- comparison
def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """method: return flag and line status; seed: line number; task: brand; value: mean discount."""
    li = table(spark, sf, "lineitem", ["l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_discount"])
    p = table(spark, sf, "part", ["p_partkey", "p_brand"])
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.concat("l_returnflag", "l_linestatus").alias("method"), F.col("l_linenumber").alias("seed"), F.col("p_brand").alias("task")).agg(F.round(F.avg("l_discount"), 6).alias("value"))


_FACTS = """facts AS (SELECT l_returnflag || l_linestatus AS method, l_linenumber AS seed, p_brand AS task, round(avg(l_discount), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
agg AS (SELECT method, task, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS std, count(value)::BIGINT AS n FROM facts GROUP BY ALL)"""


def _agg(spark: SparkSession, sf: str) -> DataFrame:
    return K.seed_aggregate(K.valid_facts(_facts(spark, sf)), ["method", "task"])


@query(f"WITH {_FACTS} SELECT method, task, round(mean, 9) AS mean, round(std, 9) AS std, n FROM agg")
def seed_aggregate(spark, sf):
    """AGG-06, FIL-06, FIL-07, T10."""
    return _agg(spark, sf).select("method", "task", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n")


@query(f"WITH {_FACTS} SELECT method, task, list(value ORDER BY seed) AS vals FROM facts GROUP BY ALL")
def seed_values(spark, sf):
    """AGG-07."""
    return K.seed_values(_facts(spark, sf), ["method", "task"]).withColumnRenamed("values", "vals")


@query(f"WITH {_FACTS} SELECT method, round(avg(mean), 9) AS mean, round(avg(std), 9) AS std FROM agg GROUP BY method")
def mean_of_means(spark, sf):
    """AGG-10."""
    return K.mean_of_means(_agg(spark, sf), ["method"]).select("method", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"WITH {_FACTS} SELECT method, task, rank() OVER (PARTITION BY task ORDER BY round(mean, 9) DESC)::BIGINT AS rank FROM agg")
def competition_rank(spark, sf):
    """WIN-03, T8."""
    return K.competition_rank(_agg(spark, sf), "task", F.round("mean", 9)).select("method", "task", "rank")


@query(f"WITH {_FACTS} SELECT method, task, row_number() OVER (PARTITION BY task ORDER BY -round(mean, 9) DESC, method)::BIGINT AS rank FROM agg")
def ordinal_rank(spark, sf):
    """WIN-04, T8: lower is better."""
    return K.ordinal_rank(_agg(spark, sf), "task", K.oriented(F.round("mean", 9), F.lit(False)), ["method"]).select("method", "task", "rank")


@query(f"WITH {_FACTS}, r AS (SELECT method, rank() OVER (PARTITION BY task ORDER BY round(mean, 9) DESC) AS rank FROM agg) SELECT method, round(avg(rank), 9) AS mean_rank, count(*)::BIGINT AS n_tasks FROM r GROUP BY method")
def mean_rank(spark, sf):
    """AGG-26."""
    r = K.mean_rank(K.competition_rank(_agg(spark, sf), "task", F.round("mean", 9)))
    return r.select("method", F.round("mean_rank", 9).alias("mean_rank"), "n_tasks")


_BEST = "best AS (SELECT method, task, abs(g - max(g) OVER (PARTITION BY task)) <= abs(max(g) OVER (PARTITION BY task)) * 0.05::DOUBLE AS is_best FROM (SELECT method, task, round(mean, 9) AS g FROM agg))"


@query(f"WITH {_FACTS}, {_BEST} SELECT * FROM best")
def best_with_tolerance(spark, sf):
    """WIN-12, T11."""
    return K.best_with_tolerance(_agg(spark, sf), "task", F.round("mean", 9), 0.05).select("method", "task", "is_best")


# tasks that some methods lack, so that shares of all tasks differ from shares of a method's own
_SPARSE = f"{_FACTS}, own AS (SELECT method, task, round(mean, 9) AS g FROM agg WHERE NOT (method = 'NF' AND task LIKE '%1') AND NOT (method = 'AF' AND task LIKE '%2'))"


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    return _agg(spark, sf).where(~((F.col("method") == "NF") & F.col("task").endswith("1")) & ~((F.col("method") == "AF") & F.col("task").endswith("2")))


@query(f"""WITH {_SPARSE}, w AS (SELECT method, count(*) FILTER (WHERE abs(g - top) <= abs(top) * 0.02::DOUBLE) AS wins FROM own JOIN (SELECT task, max(g) AS top FROM own GROUP BY task) USING (task) GROUP BY method)
SELECT method, round(100.0::DOUBLE * wins / n, 9) AS win_percent, n::BIGINT AS n_tasks FROM w, (SELECT count(DISTINCT task) AS n FROM own)""")
def win_pct(spark, sf):
    """AGG-11: head to head, over all tasks, with a tolerance wide enough to show near ties."""
    w = K.win_percent(_sparse(spark, sf), "task", F.round("mean", 9), tolerance=0.02)
    return w.select("method", F.round("win_percent", 9).alias("win_percent"), "n_tasks")


@query(f"""WITH {_SPARSE}, r AS (SELECT task, min(g) AS best FROM own WHERE method NOT LIKE 'N%' GROUP BY task),
w AS (SELECT method, count(*) FILTER (WHERE best IS NULL OR g <= best + abs(best) * 0.001::DOUBLE) AS wins FROM own LEFT JOIN r USING (task) WHERE method LIKE 'N%' GROUP BY method)
SELECT method, round(100.0::DOUBLE * wins / n, 9) AS win_percent, n::BIGINT AS n_tasks FROM w, (SELECT count(DISTINCT task) AS n FROM own)""")
def win_pct_against_rivals(spark, sf):
    """AGG-11: against the best of the others, lower is better."""
    w = K.win_percent(_sparse(spark, sf), "task", K.oriented(F.round("mean", 9), F.lit(False)), F.col("method").startswith("N"))
    return w.select("method", F.round("win_percent", 9).alias("win_percent"), "n_tasks")


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo p values, squared so that some are small."""
    u = keys.hash32("o_orderkey") % 1_000_000 / 1e6
    return table(spark, sf, "orders", ["o_orderkey"]).select("o_orderkey", F.round(u * u * u * u, 12).alias("p"))


_TESTS = f"t AS (SELECT o_orderkey, round(u * u * u * u, 12) AS p FROM (SELECT o_orderkey, {H.format('o_orderkey::VARCHAR')} % 1000000 / 1e6::DOUBLE AS u FROM orders))"


@query(f"""WITH {_TESTS}, k AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM t), c AS (SELECT max(p) AS cut FROM k WHERE p <= k::DOUBLE / n * 0.05::DOUBLE)
SELECT o_orderkey, coalesce(p <= cut, false) AS rejected FROM t, c""")
def bh_fdr(spark, sf):
    """WIN-05, T15."""
    return K.benjamini_hochberg(_tests(spark, sf)).select("o_orderkey", "rejected")


@query(f"WITH {_TESTS} SELECT o_orderkey, p < 0.05::DOUBLE / (SELECT count(*) FROM t) AS rejected FROM t")
def bonferroni(spark, sf):
    """WIN-05, T15."""
    return K.bonferroni(_tests(spark, sf)).select("o_orderkey", "rejected")


_PAIRS = f"""{_FACTS}, s AS (SELECT task, method, avg(value) AS mean, var_samp(value) AS var, count(*) AS n FROM facts GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT a.task, a.method AS method_a, b.method AS method_b, a.mean AS mean_a, b.mean AS mean_b, a.var / a.n AS va, b.var / b.n AS vb, a.n AS na, b.n AS nb FROM s a JOIN s b ON a.task = b.task AND a.method < b.method),
w AS (SELECT *, CASE WHEN va + vb > 0 THEN (mean_a - mean_b) / sqrt(va + vb) END AS t, CASE WHEN va + vb > 0 THEN (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) END AS df FROM pairs)"""


def _welch(spark: SparkSession, sf: str) -> DataFrame:
    return K.welch(K.method_pairs(K.summary(_facts(spark, sf))))


@query(f"WITH {_PAIRS} SELECT task, method_a, method_b, round(t, 6) AS t, round(df, 6) AS df FROM w")
def welch_t(spark, sf):
    """MTH-10, JOI-10."""
    return _welch(spark, sf).select("task", "method_a", "method_b", F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


# a p value that SQL can state, exp(-t^2 / 2), stands for the test's own, so that the rules after it can be compared
_RULED = f"""{_PAIRS}, p AS (SELECT *, CASE WHEN t IS NULL THEN NULL ELSE round(exp(-t * t / 2.0::DOUBLE), 9) END AS p FROM w), z AS (SELECT count(p) AS n FROM p),
k AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM p WHERE p IS NOT NULL), c AS (SELECT max(p) AS cut FROM k, z WHERE p <= k::DOUBLE / n * 0.3::DOUBLE),
x AS (SELECT *, {{rule}} AS rejected, mean_a <= mean_b AS a_first FROM p, z, c)"""
_BH, _BONFERRONI, _NONE = "coalesce(p <= cut, false)", "coalesce(p < 0.3::DOUBLE / n, false)", "coalesce(p < 0.3::DOUBLE, false)"


def _ruled(spark: SparkSession, sf: str, correction: str) -> DataFrame:
    tested = _welch(spark, sf).withColumn("p", F.round(F.exp(-F.col("t") * F.col("t") / 2.0), 9))
    return K.significant(tested, correction, alpha=0.3)


def _wins_sql(rule: str) -> str:
    return f"""WITH {_RULED.format(rule=rule)}, o AS (SELECT CASE WHEN a_first THEN method_a ELSE method_b END AS better, CASE WHEN a_first THEN method_b ELSE method_a END AS worse, rejected FROM x),
sides AS (SELECT better AS method, worse AS other, rejected AS win, NOT rejected AS tie FROM o UNION ALL SELECT worse, better, false, NOT rejected FROM o)
SELECT method, other, count(*) FILTER (WHERE win)::BIGINT AS wins, count(*) FILTER (WHERE tie)::BIGINT AS ties FROM sides GROUP BY ALL HAVING count(*) FILTER (WHERE win OR tie) > 0"""


@query(_wins_sql(_BH))
def pairwise_wins(spark, sf):
    """AGG-12, WIN-15: by ordered pair, lower is better, false discovery rate over all tasks."""
    return K.pair_wins(_ruled(spark, sf, "bh"), F.lit(False))


@query(_wins_sql(_BONFERRONI))
def pairwise_wins_bonferroni(spark, sf):
    """AGG-12, WIN-15, WIN-05."""
    return K.pair_wins(_ruled(spark, sf, "bonferroni"), F.lit(False))


@query(f"""WITH {_RULED.format(rule=_NONE)}, best AS (SELECT task, arg_min(method, struct_pack(m := mean, n := method)) AS best FROM s GROUP BY task HAVING count(*) > 1),
apart AS (SELECT task, method_a AS method, method_b AS best FROM x WHERE rejected UNION SELECT task, method_b, method_a FROM x WHERE rejected)
SELECT s.method, count(*)::BIGINT AS participation, count(*) FILTER (WHERE best.best IS NOT NULL AND apart.task IS NULL)::BIGINT AS top_rank
FROM s LEFT JOIN best USING (task) LEFT JOIN apart ON apart.task = s.task AND apart.method = s.method AND apart.best = best.best GROUP BY s.method""")
def top_ranks(spark, sf):
    """AGG-12, T21: the best and whoever is not significantly different from it, variances unequal."""
    return K.top_ranks(_ruled(spark, sf, "none"), K.summary(_facts(spark, sf)), F.lit(False))


@query(f"""WITH {_FACTS}, sc AS (SELECT DISTINCT p_brand AS task, 0.05::DOUBLE + len(p_brand) / 100.0::DOUBLE AS scale FROM part WHERE p_brand LIKE '%3')
SELECT method, seed, task, round(CASE WHEN scale IS NULL THEN value ELSE 1 - value / scale END, 9) AS value, scale IS NOT NULL AS higher FROM facts LEFT JOIN sc USING (task)""")
def scaled_mae(spark, sf):
    """AGG-12, MTH-09: errors with a scale become scores."""
    scales = table(spark, sf, "part", ["p_brand"]).where(F.col("p_brand").endswith("3")).select(F.col("p_brand").alias("task"), (0.05 + F.length("p_brand") / 100.0).alias("scale")).distinct()
    return K.scaled_errors(_facts(spark, sf), scales, F.lit(False)).select("method", "seed", "task", F.round("value", 9).alias("value"), "higher")


@query(f"""WITH {_PAIRS}, g AS (SELECT *, unnest(range(0, 1001)) AS i FROM w WHERE t IS NOT NULL AND df > 0),
f AS (SELECT task, method_a, method_b, t, df, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 1000.0::DOUBLE, 2) / df, -(df + 1) / 2) AS y FROM g),
q AS (SELECT task, method_a, method_b, 1 - 2 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(pi() * any_value(df)) * abs(any_value(t)) / 3000.0::DOUBLE * sum(y) AS p FROM f GROUP BY ALL)
SELECT task, method_a, method_b, round(p, 5) AS p FROM w LEFT JOIN q USING (task, method_a, method_b)""")
def welch_p(spark, sf):
    """MTH-10: two-sided p."""
    return significance.p_values(_welch(spark, sf), "t", "df", None).select("task", "method_a", "method_b", F.round("p", 5).alias("p"))


@query(f"""WITH {_PAIRS}, g AS (SELECT *, unnest(range(0, 1001)) AS i FROM w WHERE t IS NOT NULL AND df > 0),
f AS (SELECT task, method_a, method_b, t, df, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 1000.0::DOUBLE, 2) / df, -(df + 1) / 2) AS y FROM g),
q AS (SELECT task, method_a, method_b, 1 - 2 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(pi() * any_value(df)) * abs(any_value(t)) / 3000.0::DOUBLE * sum(y) AS p FROM f GROUP BY ALL)
SELECT task, method_a, method_b, round(p, 4) AS p FROM w LEFT JOIN q USING (task, method_a, method_b)""")
def range_p_of_two(spark, sf):
    """UDA-05, MTH-10: the studentised range of two means is sqrt 2 times the t statistic, so its p is that of the t test."""
    q = K.studentised_range(K.method_pairs(K.summary(_facts(spark, sf))), None).withColumn("k", F.lit(2).cast("long"))
    return significance.p_values(q, "q", "q_df", "k").select("task", "method_a", "method_b", F.round("p", 4).alias("p"))


# the normal distribution by sums on a grid of 1/128 with the end corrections of the trapezoid rule, between grid points by Taylor's series;
# the tail of the range of k normals at w = 16 (i / 8192)^2, i = 0 .. 8192; Simpson's rule over the deviation s = w / q
_RANGE_P = """ks AS (SELECT DISTINCT k FROM q), z AS (SELECT i, i / 32.0::DOUBLE AS z, exp(-pow(i / 32.0::DOUBLE, 2) / 2) / sqrt(2 * pi()) AS f FROM range(-288, 289) r(i)),
g AS (SELECT g, g / 128.0::DOUBLE AS z, exp(-pow(g / 128.0::DOUBLE, 2) / 2) / sqrt(2 * pi()) AS f FROM range(-3300, 1300) r(g)),
phi AS (SELECT g, z, f, (sum(f) OVER (ORDER BY g) - f / 2) / 128.0::DOUBLE + z * f / 12 / pow(128.0::DOUBLE, 2) + (3 * z - pow(z, 3)) * f / 720 / pow(128.0::DOUBLE, 4) AS v FROM g),
x AS (SELECT i, 16 * pow(i / 8192.0::DOUBLE, 2) AS w FROM range(0, 8193) r(i)),
c AS (SELECT x.i AS i, z.f AS f, z.i AS zi, z.z - x.w AS x, round((z.z - x.w) * 128)::BIGINT AS g FROM x, z),
n AS (SELECT c.i, c.f, p.v - (h.v + h.f * (x - h.z) - h.z * h.f * pow(x - h.z, 2) / 2 + (h.z * h.z - 1) * h.f * pow(x - h.z, 3) / 6 - (pow(h.z, 3) - 3 * h.z) * h.f * pow(x - h.z, 4) / 24) AS d FROM c JOIN phi p ON p.g = 4 * zi JOIN phi h ON h.g = c.g),
tail AS (SELECT k, i, 1 - k * sum(f * pow(greatest(d, 0), k - 1)) / 32.0::DOUBLE AS t FROM n, ks GROUP BY k, i),
e AS (SELECT task, method_a, method_b, q, q_df, t, i, 16 * pow(i / 8192.0::DOUBLE, 2) / q AS s, CASE WHEN i IN (0, 8192) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3.0::DOUBLE * 32 * i / pow(8192.0::DOUBLE, 2) / q AS ds FROM q JOIN tail USING (k) WHERE q > 0 AND q_df >= 1 AND i > 0),
p AS (SELECT task, method_a, method_b, sum(ds * t * exp(ln(2.0::DOUBLE) + q_df / 2 * ln(q_df / 2) - lgamma(q_df / 2) + (q_df - 1) * ln(s) - q_df * s * s / 2)) AS p FROM e GROUP BY ALL)"""


@query(f"""WITH {_PAIRS}, pool AS (SELECT task, sum(var * (n - 1)) / sum(n - 1) AS pv, sum(n - 1)::DOUBLE AS q_df, count(*) AS k FROM s GROUP BY task),
q AS (SELECT task, method_a, method_b, abs(mean_a - mean_b) / sqrt(pv / 2 * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS q, q_df, k FROM pairs JOIN pool USING (task) WHERE pv > 0), {_RANGE_P}
SELECT q.task, q.method_a, q.method_b, round(q, 6) AS q, round(p, 4) AS p FROM q LEFT JOIN p USING (task, method_a, method_b)""")
def hsd_pvalues(spark, sf):
    """UDA-05, MTH-10: Tukey-Kramer p of all pairs."""
    s = K.summary(_facts(spark, sf))
    q = K.studentised_range(K.method_pairs(s), K.pooled(s))
    return significance.range_p_values(q, "q", "q_df", "k").select("task", "method_a", "method_b", F.round("q", 6).alias("q"), F.round("p", 4).alias("p"))


@query(f"""WITH {_PAIRS}, m AS (SELECT task, count(*) AS k FROM s GROUP BY task), q AS (SELECT task, method_a, method_b, abs(t) * sqrt(2.0::DOUBLE) AS q, df AS q_df, k FROM w JOIN m USING (task) WHERE t IS NOT NULL), {_RANGE_P},
r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS n FROM p), cut AS (SELECT max(p) AS cut FROM r WHERE p <= i::DOUBLE / n * 0.05::DOUBLE)
SELECT w.task, w.method_a, w.method_b, round(p, 4) AS p, coalesce(p <= cut, false) AS rejected FROM w LEFT JOIN p USING (task, method_a, method_b), cut""")
def games_howell(spark, sf):
    """UDA-05, T16: unequal variances, then the false discovery rate over all pairs."""
    s = K.summary(_facts(spark, sf))
    q = K.studentised_range(K.method_pairs(s), None).join(s.groupBy("task").agg(F.count("*").alias("k")), "task")
    return K.benjamini_hochberg(significance.range_p_values(q, "q", "q_df", "k")).select("task", "method_a", "method_b", F.round("p", 4).alias("p"), "rejected")


@query(f"WITH {_FACTS} SELECT task, round(min(mean), 9) AS best FROM agg GROUP BY task")
def tasks_by_best(spark, sf):
    """AGG-27, SRT-03."""
    return K.tasks_by_best(_agg(spark, sf), "task", "mean").select("task", F.round("best", 9).alias("best"))


@query("SELECT (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size > 45 INTERSECT SELECT p_brand FROM part WHERE p_size < 3))::BIGINT AS n")
def common_tasks(spark, sf):
    """JOI-09, SET-04."""
    p = table(spark, sf, "part").select(F.when(F.col("p_size") > 45, "large").when(F.col("p_size") < 3, "small").alias("method"), F.col("p_brand").alias("task"))
    return K.common_tasks(p, "large", "small").agg(F.count("*").alias("n"))


@query("""SELECT method, CASE WHEN contains(method, 'F') THEN 0 WHEN contains(method, 'A') THEN 1 ELSE 2 END::BIGINT AS priority FROM (SELECT DISTINCT l_returnflag || l_linestatus AS method FROM lineitem)""")
def method_order(spark, sf):
    """SRT-04, AGG-31."""
    m = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("method")).distinct()
    return K.priority_sort(m, ["F", "A"])


@query(f"""WITH {_FACTS} SELECT method, task, CASE method WHEN 'AF' THEN 'Our Model' ELSE upper(substr(method, 1, 1)) || lower(substr(method, 2)) END AS name,
  printf('%.3f', round(round(mean, 9), 3)) || ' +/- ' || printf('%.3f', round(round(std, 9), 3)) AS cell FROM agg WHERE lower(method) <> 'ro'""")
def result_cells(spark, sf):
    """STR-06, STR-08, FIL-11."""
    a = K.exclude_methods(_agg(spark, sf), ["RO"])
    name = keys.display_name(F.col("method"), {"AF": "Our Model"}, ("model_",), ("_v1",))
    return a.select("method", "task", name.alias("name"), keys.mean_std_text(F.round("mean", 9), F.round("std", 9)).alias("cell"))


@query(f"WITH {_FACTS} SELECT method, seed::VARCHAR AS seed, task, 'score' AS metric, value FROM facts")
def cube_round_trip(spark, sf):
    """SRC-16, JSN-01, MAP-01: facts to a JSON cube for each method and back."""
    facts = _facts(spark, sf).select("method", F.col("seed").cast("string").alias("seed"), "task", F.lit("score").alias("metric"), "value")
    return tables.explode_cube(tables.cube_json(facts, ["method"]), "json", ["method"])


@query("""SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE c_acctbal::VARCHAR END AS DOUBLE), 0.0) AS cell FROM customer""")
def gaps_to_zero(spark, sf):
    """SRC-18, FIL-04."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(F.col("c_acctbal").cast("string")).alias("cell"))
    return tables.gaps_to(c, {"cell": 0.0})
