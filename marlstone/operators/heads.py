"""Models for each task from sums that any number of tasks of Spark add up: no task's rows ever meet in one place.

Ridge regression needs the products of all pairs of columns, summed by task and fold: each partition adds up its own with numpy,
Spark adds those, and all candidates of a random search are fitted and scored on held-out folds from the sums alone, without
another pass. Logistic regression adds up a gradient and a curvature for each of a few Newton steps. Models are rows
(task, weights; the intercept first), so that predicting is a join and a dot product.

Rows without a label or with a null task, and rows whose features are null or of another length, are left out of fitting. A task whose
target or feature does not vary has a deviation of 1 in its place. A task without fitting rows has no model and null predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.keys import hash32
from ..session import written

FLUSH = 1 << 22  # numbers that a partition adds up before it hands them on
#: Cumulative shares of the Poisson distribution with mean 1, for how often a bagged row counts.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def candidates(spark: SparkSession, n: int, seed: int, low: float = -3.0, high: float = 1.0) -> DataFrame:
    """UDA-02: candidate (0 .. n-1) and ridge, drawn log-uniformly from 10**low to 10**high."""
    u = (hash32(F.lit(f"{seed}/"), "candidate") + 0.5) / 4294967296.0
    return spark.range(n).select(F.col("id").cast("int").alias("candidate")).withColumn("ridge", F.pow(F.lit(10.0), low + (high - low) * u))


def bag_weights(key: list[str], members: int, seed: int) -> Column:
    """UDA-01: for each member how often a row counts: 0, 1, 2, ... as in a bootstrap, by a hash of its key."""
    u = lambda m: hash32(F.lit(f"{seed}/{m}/"), *key) / 4294967296.0
    return F.array(*[sum((F.when(u(m) >= p, 1.0).otherwise(0.0) for p in POISSON), F.lit(0.0)) for m in range(members)])


def _fitting(df: DataFrame, task: str, x: str, y: str, width: int) -> Column:
    return F.col(task).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & (F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def _added(rows: DataFrame, task: str, keys: list[str], sums) -> DataFrame:
    """task, keys and m: arrays that sums(batch) yields as (task value, key values, flat array), added up."""
    schema = StructType([StructField("task", rows.schema[task].dataType), *[StructField(k, IntegerType()) for k in keys], StructField("pos", IntegerType()), StructField("value", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple, np.ndarray] = {}

        def out():
            for at, m in held.items():
                pos = np.flatnonzero(m)
                n = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, arrow.field(i).type) for i, v in enumerate(at)] + [pa.array(pos, pa.int32()), pa.array(m[pos])], schema=arrow)
            held.clear()

        for batch in batches:
            for at, m in sums(batch):
                held[at] = held[at] + m if at in held else m
            if sum(m.size for m in held.values()) > FLUSH:
                yield from out()
        yield from out()

    parts = rows.mapInArrow(run, schema).groupBy("task", *keys, "pos").agg(F.sum("value").alias("value"))
    return parts.groupBy("task", *keys).agg(F.collect_list(F.struct("pos", "value")).alias("m"))  # one row for each pair of columns


def matrix(m: list[dict], size: int) -> np.ndarray:
    """The flat array of the cells that moments holds."""
    out = np.zeros(size)
    for cell in m:
        out[cell["pos"]] = cell["value"]
    return out


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def moments(df: DataFrame, task: str, x: str, y: str, fold: str, width: int, center: list[float], bags: str | None = None) -> DataFrame:
    """task, part and m: sums of products of (1, features, target), less center; part: the fold, or -1, -2, ... for the members of bags."""
    shift = np.array([0.0, *center])
    size = width + 2
    known = df.where(_fitting(df, task, x, y, width)).select(F.col(task).alias("task"), F.col(fold).cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), (F.col(bags) if bags else F.array().cast("array<double>")).alias("w"))

    def sums(batch: pa.RecordBatch):
        n = batch.num_rows
        if not n:
            return
        z = np.c_[np.ones(n), _stacked(batch.column(2), width), batch.column(3).to_numpy(zero_copy_only=False)] - shift
        tasks, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        w = _stacked(batch.column(4), len(batch.column(4)[0])) if bags else None
        groups: dict[tuple, list[int]] = {}
        for i, at in enumerate(zip(tasks, folds, strict=True)):
            groups.setdefault(at, []).append(i)
        for (t, f), rows in groups.items():
            part = z[rows]
            yield (t, f), (part.T @ part).ravel()
            for m in range(w.shape[1] if bags else 0):
                yield (t, -1 - m), (part.T @ (part * w[rows, m : m + 1])).ravel()

    return _added(known, "task", ["part"], sums).withColumn("size", F.lit(size))


def ridge_weights(m: np.ndarray, ridges: np.ndarray) -> np.ndarray:
    """Weights (intercept first) for each of ridges from sums of products; penalties are on features over their deviation."""
    n, means = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    scale[scale < 1e-8] = 1.0
    values, vectors = np.linalg.eigh(cov[:-1, :-1] / np.outer(scale, scale))  # once for all candidates
    turned = vectors.T @ (cov[:-1, -1] / scale)
    below = np.maximum(values, 0)[None, :] + ridges[:, None]
    w = np.divide(turned[None, :], below, out=np.zeros((len(ridges), len(turned))), where=below > 1e-12) @ vectors.T / scale
    return np.c_[means[-1] - w @ means[:-1], w]


def ridge_search(m: DataFrame, tried: list[tuple[int, float]], center: list[float]) -> DataFrame:
    """UDA-02: task, candidate, ridge, cv_mse (mean squared error over folds, each scored by the model of the others) and weights
    (of all folds, or the mean over bags): one row for each task and candidate."""
    ridges = np.array([r for _, r in tried])
    shift = np.array(center)
    kind = m.schema["task"].dataType
    schema = StructType([StructField("task", kind), StructField("candidate", IntegerType()), StructField("ridge", DoubleType()), StructField("n", DoubleType()), StructField("cv_mse", DoubleType()), *StructType.fromDDL("weights array<double>").fields])
    arrow = to_arrow_schema(schema)

    def solve(batches):
        for batch in batches:
            out = []
            for task, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = parts[0]["size"]
                sums = {p["part"]: matrix(p["m"], size * size).reshape(size, size) for p in parts}
                folds = {k: v for k, v in sums.items() if k >= 0}
                total = sum(folds.values())
                error = np.zeros(len(ridges))
                for held in folds.values():
                    rest = total - held
                    w = ridge_weights(rest, ridges) if rest[0, 0] > 0.5 else np.zeros((len(ridges), size - 1))
                    full = np.c_[w, -np.ones(len(ridges))]  # residual of (1, x, y)
                    error += np.einsum("ci,ij,cj->c", full, held, full)
                bags = [v for k, v in sums.items() if k < 0 and v[0, 0] > 0.5]
                w = np.mean([ridge_weights(b, ridges) for b in bags], axis=0) if bags else ridge_weights(total, ridges)
                w[:, 0] += shift[-1] - w[:, 1:] @ shift[:-1]
                out += [(task, c, r, total[0, 0], max(e, 0.0) / total[0, 0], list(x)) for (c, r), e, x in zip(tried, error, w, strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    whole = m.groupBy("task").agg(F.collect_list(F.struct("part", "m", "size")).alias("parts"))  # as many as folds and bags
    return whole.mapInArrow(solve, schema)


def centers(df: DataFrame, task: str, x: str, y: str, width: int) -> list[float]:
    """Means of the features and the target over all fitting rows: sums are taken around them, so that they stay exact."""
    known = df.where(_fitting(df, task, x, y, width))
    row = known.agg(*[F.coalesce(F.avg(F.get(x, F.lit(i)).cast("double")), F.lit(0.0)) for i in range(width)], F.coalesce(F.avg(F.col(y).cast("double")), F.lit(0.0))).first()
    return [float(v) for v in row]


def fit_ridge(df: DataFrame, task: str, x: str, y: str, fold: str, width: int, tried: DataFrame, bags: str | None = None) -> DataFrame:
    """UDA-01, UDA-02: one row a task: the candidate with the least cv_mse (of equals the first), with ridge, n, cv_mse, weights.

    tried: candidate and ridge, a bounded list; bags: a column of bag_weights."""
    listed = [(r.candidate, r.ridge) for r in tried.orderBy("candidate").collect()]
    center = centers(df, task, x, y, width)
    all_rows = ridge_search(moments(df, task, x, y, fold, width, center, bags), listed, center)
    best = all_rows.groupBy("task").agg(F.min(F.struct("cv_mse", "candidate", "ridge", "n", "weights")).alias("b"))
    return best.select(F.col("task").alias(task), *[F.col("b")[c].alias(c) for c in ("candidate", "ridge", "n", "cv_mse", "weights")])


def linear(x: Column, weights: Column) -> Column:
    """The dot product with the intercept; null for features of another length."""
    products = F.zip_with(x, F.slice(weights, 2, F.size(weights) - 1), lambda a, b: a * b)
    return F.aggregate(products, F.get(weights, F.lit(0)), lambda s, v: s + v)


def predict(df: DataFrame, models: DataFrame, task: str, x: str, name: str = "prediction", probability: bool = False) -> DataFrame:
    """Adds the prediction of each row's task; there is one model a task, so Spark broadcasts them below its threshold."""
    own = models.select(task, F.col("weights").alias("_w"))
    z = linear(F.col(x), F.col("_w"))
    return df.join(own, task, "left").withColumn(name, 1 / (1 + F.exp(-z)) if probability else z).drop("_w")


def fit_logistic(df: DataFrame, task: str, x: str, y: str, width: int, ridge: float, steps: int = 8) -> DataFrame:
    """UDA-03: task, n and weights of a logistic regression of y (0 or 1) for each task by Newton steps: each is one pass that adds up
    gradient and curvature. ridge times n is the penalty on features over their deviation."""
    known = written(df.where(_fitting(df, task, x, y, width)).select(F.col(task).alias("task"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")))
    means = [F.avg(F.get("x", F.lit(i))) for i in range(width)]
    stds = [F.stddev_pop(F.get("x", F.lit(i))) for i in range(width)]
    scale = known.groupBy("task").agg(F.count("*").cast("double").alias("n"), F.array(*means).alias("mean"), F.array(*[F.when(s < 1e-8, 1.0).otherwise(s) for s in stds]).alias("std"))
    models = written(scale.withColumn("w", F.array_repeat(F.lit(0.0), width + 1)))
    size = width + 1
    schema = StructType([*models.schema.fields])
    arrow = to_arrow_schema(schema)

    def sums(batch: pa.RecordBatch):
        tasks = batch.column(0).to_pylist()
        z = np.c_[np.ones(len(tasks)), _stacked(batch.column(1), width)] if tasks else None
        y, w = batch.column(2).to_numpy(zero_copy_only=False), _stacked(batch.column(3), size) if tasks else None
        groups: dict = {}
        for i, t in enumerate(tasks):
            groups.setdefault(t, []).append(i)
        for t, rows in groups.items():
            p = 1 / (1 + np.exp(-np.clip(z[rows] @ w[rows[0]], -30, 30)))
            yield (t,), np.r_[z[rows].T @ (y[rows] - p), ((z[rows] * (p * (1 - p))[:, None]).T @ z[rows]).ravel()]

    def step(batches):
        for batch in batches:
            t = batch.to_pydict()
            for i, m in enumerate(t["m"]):
                both = matrix(m, size + size * size)
                penalty = np.r_[0.0, np.full(width, ridge * t["n"][i])]
                w = np.array(t["w"][i])
                h = both[size:].reshape(size, size) + np.diag(penalty + 1e-9)
                t["w"][i] = list(np.clip(w + np.linalg.solve(h, both[:size] - penalty * w), -30, 30))
            yield pa.RecordBatch.from_arrays([pa.array(t[f.name], f.type) for f in arrow], schema=arrow)

    standard = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "std", lambda a, b: a / b)
    for _ in range(steps):
        rows = known.join(models, "task").select("task", standard.alias("x"), "y", "w")
        models = written(models.join(_added(rows, "task", [], sums), "task").select(*models.columns, "m").mapInArrow(step, schema))
    own = F.zip_with(F.slice("w", 2, width), "std", lambda a, b: a / b)
    shifted = F.get("w", F.lit(0)) - F.aggregate(F.zip_with(own, "mean", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return models.select(F.col("task").alias(task), "n", F.concat(F.array(shifted), own).alias("weights"))
