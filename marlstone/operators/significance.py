"""Tail probabilities of Student's t and of the studentised range.

The range of k normals is tabulated once for each k, by numpy; the distribution over the deviation is then integrated by native
expressions, one row at a time. The grids below are those of Gauss-Legendre quadrature, built by numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, WIDEST = 128, 16  # table points to a unit of the range, and its end: beyond it the tail is below 1e-20 for 1,000 means
NODES = 64  # of the integral over the deviation
_X, _W = np.polynomial.legendre.leggauss(96)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """MTH-10: two-sided p of Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    z = 8.0 * _X
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = _normal_cdf(z)[None, :] - _normal_cdf(z[None, :] - w[:, None])
    return np.clip(k * 8.0 * ((_W * density)[None, :] * np.maximum(inner, 0) ** (k - 1)).sum(1), 0, 1)


def studentised_range_sf(q: float, k: int, df: float) -> float:
    """UDA-05: P(studentised range of k means > q), by integrating over the chi distribution of the deviation."""
    if not q > 0 or k < 2:
        return 1.0
    if df > 5000:
        return float(1 - _range_cdf(np.array([q]), k)[0])
    spread = 9 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - spread), 1 + spread
    if df < 20:
        low, high = 1e-9, 1 + 12 / math.sqrt(2 * df)
    s = (high - low) / 2 * _X + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    cdf = (high - low) / 2 * (_W * np.exp(log_density) * _range_cdf(q * s, k)).sum()
    return float(min(1.0, max(0.0, 1 - cdf)))


def p_values(tests: DataFrame, statistic: str, df: str, k: str | None, name: str = "p") -> DataFrame:
    """UDA-05, MTH-10: adds two-sided p of t, or with k (a column of numbers of means) of the studentised
    range. Null where the statistic is (zero variance: the test is skipped)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*tests.schema.fields, StructField(name, DoubleType())])
    arrow, at = to_arrow_schema(schema), [tests.columns.index(c) for c in (statistic, df, k) if c]

    def run(batches):
        for batch in batches:
            known: dict[tuple, float | None] = {}  # the integral is taken once for equal rows of a batch
            out = []
            for r in zip(*(batch[i].to_pylist() for i in at), strict=True):
                if r not in known:
                    known[r] = None if any(v is None or v != v for v in r) or r[1] <= 0 else t_two_sided(r[0], r[1]) if len(r) == 2 else studentised_range_sf(r[0], int(r[2]), r[1])
                out.append(known[r])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema=arrow)

    return tests.mapInArrow(run, schema)


# ----------------------------------------------------------------- native
def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0, to 1e-12: Stirling's series at x + 12."""
    z = x + 12
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda a, i: a + F.log(x + i))


def range_tail(k: int) -> np.ndarray:
    """P(range of k standard normals > w) for w = -1, 0, 1, ... in steps of 1 / STEPS, up to a little more than WIDEST.

    The trapezoid rule over all z is exact to rounding for such integrands. Below 0 the function goes on analytically."""
    n = WIDEST * STEPS + 3
    grid = np.arange(-(9 + WIDEST) * STEPS - 4, 9 * STEPS + 1)
    phi = _normal_cdf(grid / STEPS)
    at = np.arange(-9 * STEPS, 9 * STEPS + 1, STEPS // 32)  # z, as multiples of 1 / STEPS
    z = at / STEPS
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / 32
    inside = phi[at - grid[0]][None, :] - phi[at[None, :] - np.arange(n)[:, None] - grid[0]]
    below = k * (density * inside ** (k - 1)).sum(1)
    return 1 - np.r_[(-1) ** (k - 1) * below[1], below]


def range_tables(ks: DataFrame) -> DataFrame:
    """k and tail, one row for each distinct k of at least 2: as many as there are numbers of methods."""

    def run(batches):
        for batch in batches:
            k = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([range_tail(x).tolist() for x in k], pa.list_(pa.float64()))], ["k", "tail"])

    return ks.where("k >= 2").select(F.col("k").cast("long")).distinct().mapInArrow(run, "k long, tail array<double>")


def range_p(q: Column, df: Column, tail: Column) -> Column:
    """P(studentised range > q) with df degrees of freedom (at least 1), from the table of its k; to 1e-8."""
    far = F.when(df < 20, 12.0).otherwise(9.0) / F.sqrt(2 * df)
    low, high = F.greatest(F.lit(0.0), F.when(df < 20, F.lit(0.0)).otherwise(1 - far)), F.least(1 + far, WIDEST / q)  # beyond WIDEST / q the tail is 0
    a, b = F.sqrt(low), F.sqrt(high)  # the deviation is x * x, which takes its root at 0 away
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    constant = math.log(2) + df / 2 * F.log(df / 2) - log_gamma(df / 2)
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(nodes, weights, strict=True)])

    def tail_at(w: Column) -> Column:
        """Cubic interpolation; entry i of the table stands at i - 1 steps."""
        i = F.least(F.floor(w * STEPS).cast("int"), F.lit(WIDEST * STEPS - 1))
        t = w * STEPS - i
        y = [F.get(tail, i + j) for j in range(4)]
        return -y[0] * t * (t - 1) * (t - 2) / 6 + y[1] * (t + 1) * (t - 1) * (t - 2) / 2 - y[2] * (t + 1) * t * (t - 2) / 2 + y[3] * (t + 1) * t * (t - 1) / 6

    def term(total: Column, node: Column) -> Column:
        x = (b - a) / 2 * node["x"] + (b + a) / 2
        s = x * x
        return total + node["w"] * 2 * x * F.exp(constant + (df - 1) * F.log(s) - df * s * s / 2) * tail_at(q * s)

    p = F.aggregate(pairs, F.lit(0.0), term) * (b - a) / 2
    return F.when(q <= 0, 1.0).when(high <= low, 0.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def range_p_values(tests: DataFrame, q: str, df: str, k: str, name: str = "p") -> DataFrame:
    """UDA-05, MTH-10: adds p of the studentised range of k means, by native expressions over a table for each k. Null where one of the
    three is null or NaN or df is below 1; 1 for fewer than two means."""
    tables = range_tables(tests.select(F.col(k).alias("k"))).withColumnRenamed("k", "_k")
    known = F.col(q).isNotNull() & ~F.isnan(q) & F.col(df).isNotNull() & ~F.isnan(df) & (F.col(df) >= 1) & F.col(k).isNotNull()
    joined = tests.join(tables, F.col(k).cast("long") == F.col("_k"), "left")
    p = F.when(F.col(k) < 2, 1.0).otherwise(range_p(F.col(q), F.col(df).cast("double"), F.col("tail")))
    return joined.withColumn(name, F.when(known, p)).drop("_k", "tail")
