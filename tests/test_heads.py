"""Models from sums equal models fitted on all rows of a task in one place."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import fallible, heads

D, FOLDS = 3, 4


def made_up(seed=0, n=900):
    """Two thirds of the rows belong to one task; features far from 0; labels and features missing here and there."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        task = rng.choice(["big", "big", "b", "c"]) if i > 5 else "tiny" if i else "flat"
        x = (rng.normal(size=D) * [1, 50, 0.01] + [1e6, -300, 5]).tolist()
        y = 2 * x[0] - 0.5 * x[1] + 40 * x[2] + rng.normal() * 3 + (10 if task == "b" else 0)
        rows.append((task, x, float(y) if task != "flat" else 7.0, i))
    rows += [("big", None, 1.0, n), ("big", [1.0], 1.0, n + 1), ("big", [1.0, None, 2.0], 1.0, n + 2), ("big", [1.0, 2.0, 3.0], None, n + 3), (None, [1.0, 2.0, 3.0], 1.0, n + 4), ("none", [1.0, 2.0, 3.0], None, n + 5), ("big", [float("nan"), 2.0, 3.0], 1.0, n + 6)]
    return rows


def ridge(x, y, k):
    s = x.std(0)
    s[s < 1e-8] = 1
    m = x.mean(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z / len(x) + k * np.eye(D), z.T @ (y - y.mean()) / len(x)) / s
    return np.r_[y.mean() - m @ w, w]


def fitting(rows, task):
    kept = [(x, y, i) for t, x, y, i in rows if t == task and y is not None and x is not None and len(x) == D and None not in x and not any(np.isnan(x))]
    return np.array([r[0] for r in kept]), np.array([r[1] for r in kept]), np.array([r[2] for r in kept])


def frame(spark, rows):
    return spark.createDataFrame(rows, "task string, x array<double>, y double, id long").repartition(16).withColumn("fold", (F.col("id") % FOLDS).cast("int"))


def test_ridge_equals_the_fit_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(heads, "FLUSH", 50)
    rows = made_up()
    df = frame(spark, rows)
    tried = heads.candidates(spark, 5, 3)
    ridges = {r.candidate: r.ridge for r in tried.collect()}
    assert all(1e-3 <= v <= 10 for v in ridges.values()) and len(set(ridges.values())) == 5
    got = {r.task: r for r in heads.fit_ridge(df, "task", "x", "y", "fold", D, tried).collect()}
    assert got.keys() == {"big", "b", "c", "tiny", "flat"}
    for task in ("big", "b", "c"):
        x, y, i = fitting(rows, task)
        errors = {}
        for c, k in ridges.items():
            held = [(np.c_[np.ones((i % FOLDS == f).sum()), x[i % FOLDS == f]] @ ridge(x[i % FOLDS != f], y[i % FOLDS != f], k) - y[i % FOLDS == f]) for f in range(FOLDS)]
            errors[c] = (np.concatenate(held) ** 2).mean()
        best = min(errors, key=errors.get)
        assert (got[task].candidate, got[task].n) == (best, len(y)) and np.isclose(got[task].cv_mse, errors[best], rtol=1e-6)
        assert np.allclose(got[task].weights, ridge(x, y, ridges[best]), rtol=1e-6)
    assert np.allclose(heads.predict(df.where("task = 'flat'"), spark.createDataFrame([("flat", got["flat"].weights)], "task string, weights array<double>"), "task", "x").first().prediction, 7)


def test_predictions_of_tasks_without_a_model_are_null(spark):
    df = frame(spark, made_up())
    models = heads.fit_ridge(df, "task", "x", "y", "fold", D, heads.candidates(spark, 2, 1))
    out = heads.predict(df, models, "task", "x")
    assert out.count() == df.count()
    assert {r.task for r in out.where("prediction is null and size(x) = 3 and not exists(x, v -> v is null)").collect()} == {None, "none"}
    empty = df.where("false")
    assert heads.fit_ridge(empty, "task", "x", "y", "fold", D, heads.candidates(spark, 2, 1)).count() == 0


def test_bagged_members_equal_weighted_fits(spark):
    rows = [r for r in made_up(1, 300) if r[0] == "big"]
    df = frame(spark, rows).withColumn("bags", heads.bag_weights(["id"], 6, 4))
    weights = {r.id: r.bags for r in df.collect()}
    flat = [w for v in weights.values() for w in v]
    assert set(flat) <= set(range(9)) and 0.9 < np.mean(flat) < 1.1 and 0.8 < np.var(flat) < 1.2
    tried = spark.createDataFrame([(0, 0.1)], "candidate int, ridge double")
    got = heads.fit_ridge(df, "task", "x", "y", "fold", D, tried, "bags").first()
    x, y, i = fitting(rows, "big")
    members = []
    for m in range(6):
        times = np.array([int(weights[k][m]) for k in i])
        members.append(ridge(np.repeat(x, times, axis=0), np.repeat(y, times), 0.1))
    assert np.allclose(got.weights, np.mean(members, axis=0), rtol=1e-6)


def test_a_task_that_has_most_rows_is_added_up_by_many_tasks_of_spark(spark):
    rows = [("one", [float(i % 17), float(i % 5), 1.0], float(i % 7), i) for i in range(4000)]
    df = frame(spark, rows)
    plan = heads.moments(df, "task", "x", "y", "fold", D, [0.0] * 4)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "FlatMapGroups" not in plan
    rows_sent = heads.moments(df, "task", "x", "y", "fold", D, [0.0] * 4)
    assert rows_sent.count() == FOLDS and max(len(r.m) for r in rows_sent.collect()) <= (D + 2) ** 2


def logistic(x, y, k, steps=60):
    m, s = x.mean(0), x.std(0)
    s[s < 1e-8] = 1
    z = np.c_[np.ones(len(x)), (x - m) / s]
    w, penalty = np.zeros(D + 1), np.r_[0, np.full(D, k * len(x))]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
    own = w[1:] / s
    return np.r_[w[0] - own @ m, own]


def test_logistic_equals_newton_on_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x = (rng.normal(size=D) * [1, 20, 0.1] + [3, 100, 0]).tolist()
        rows.append((("a", "b")[i % 3 == 0], x, float(rng.random() < 1 / (1 + np.exp(-(x[0] - 3) * 2 + (x[1] - 100) / 10))), i))
    rows += [("only ones", [1.0, 2.0, 3.0], 1.0, 700), ("b", None, 1.0, 701), ("b", [1.0, 2.0, 3.0], None, 702)]
    df = frame(spark, rows)
    got = {r.task: r for r in heads.fit_logistic(df, "task", "x", "y", D, 0.01).collect()}
    for task in ("a", "b"):
        x, y, _ = fitting(rows, task)
        assert got[task].n == len(y) and np.allclose(got[task].weights, logistic(x, y, 0.01), rtol=1e-4, atol=1e-6)
    p = heads.predict(df, heads.fit_logistic(df, "task", "x", "y", D, 0.01), "task", "x", "p", probability=True)
    assert p.where("task = 'only ones'").first().p > 0.9


def test_fit_predict_brings_no_task_together(spark):
    """Least squares a task, by the standardised target, as of all its rows at once; the rows do not meet in a Python worker."""
    rng = np.random.default_rng(4)
    rows = [(t, [float(a), float(b)], float(3 * a - b + c + rng.normal()) if i % 9 else None, i % 4 == 0) for t, c in (("a", 1e4), (None, 5.0)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    rows += [("untaught", [1.0, 2.0], 3.0, True), ("flat", [1.0, 1.0], 2.0, False), ("flat", [1.0, 1.0], 2.0, True)]
    df = spark.createDataFrame(rows, "t string, x array<double>, y double, test boolean").repartition(5)
    out = fallible.fit_predict(df, "t", "x", "y", "test", fallible.least_squares, 2, members=3)
    assert "FlatMapGroupsIn" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for t in ("a", None):
        learn = [r for r in rows if r[0] == t and not r[3] and r[2] is not None]
        w = np.linalg.lstsq(np.array([[*r[1], 1.0] for r in learn]), np.array([r[2] for r in learn]), rcond=None)[0]
        want += [(t, r[2], float(np.dot([*r[1], 1.0], w))) for r in rows if r[0] == t and r[3]]
    want += [("untaught", 3.0, None), ("flat", 2.0, 2.0)]
    order = lambda r: (str(r[0]), r[1] is None, r[1] or 0.0, r[2] or 0.0)
    got = sorted(map(tuple, out.collect()), key=order)
    assert len(got) == len(want)
    for g, e in zip(got, sorted(want, key=order), strict=True):
        assert g[:2] == e[:2] and (g[2] is None) == (e[2] is None) and (g[2] is None or abs(g[2] - e[2]) < 1e-7)
