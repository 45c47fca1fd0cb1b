"""Scalar mathematics of metrics and losses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log(x: Column) -> Column:
    """MTH-01: log1p of the magnitude with the sign."""
    return F.signum(x) * F.log1p(F.abs(x))


def signed_exp(x: Column) -> Column:
    """MTH-01: the inverse of signed_log."""
    return F.signum(x) * F.expm1(F.abs(x))


def log_target(x: Column, eps: float = 1e-6) -> Column:
    """MTH-01, T26: the loss's forward transform, with eps inside both parts (so zero counts as positive)."""
    return F.signum(x + eps) * F.log1p(F.abs(x) + eps)


def sigmoid(x: Column) -> Column:
    """MTH-02."""
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """MTH-02: of p clamped to [eps, 1 - eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1.0 - q))


def softplus(x: Column) -> Column:
    """MTH-02, without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def l1(y: Column, p: Column) -> Column:
    """MTH-03."""
    return F.abs(y - p)


def l2(y: Column, p: Column) -> Column:
    """MTH-03."""
    return (y - p) * (y - p)


def huber(y: Column, p: Column, delta: float = 1.0) -> Column:
    """MTH-03."""
    e = F.abs(y - p)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def smooth_l1(y: Column, p: Column, beta: float = 1.0) -> Column:
    """MTH-03."""
    e = F.abs(y - p)
    return F.when(e < beta, 0.5 * e * e / beta).otherwise(e - 0.5 * beta)


def bce_with_logits(y: Column, x: Column) -> Column:
    """MTH-06: stable binary cross entropy."""
    return softplus(x) - x * y


def focal(y: Column, x: Column, gamma: float = 2.0, alpha: float | None = 0.25) -> Column:
    """MTH-06: focal loss from logits; gamma 0 without alpha is plain cross entropy."""
    p = sigmoid(x)
    pt = p * y + (1.0 - p) * (1.0 - y)
    loss = bce_with_logits(y, x) * F.pow(1.0 - pt, F.lit(gamma))
    return loss if alpha is None else loss * (alpha * y + (1.0 - alpha) * (1.0 - y))


def ordinal_bce(label: Column, x: Column, classes: int) -> Column:
    """MTH-05: sum over the classes - 1 thresholds k of the cross entropy of 'label > k' with logit x - k."""
    steps = F.sequence(F.lit(0), F.lit(classes - 2))
    over = F.aggregate(steps, F.lit(0.0), lambda a, k: a + softplus(x - k.cast("double")))
    below = F.aggregate(steps, F.lit(0.0), lambda a, k: a + F.when(label > k, x - k.cast("double")).otherwise(0.0))
    return over - below


def ordinal_class(x: Column, classes: int) -> Column:
    """MTH-05: thresholds passed."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(classes - 2)), F.lit(0), lambda a, k: a + (x > k.cast("double")).cast("int"))


def radial_basis(x: Column, centers: list[float], gamma: float) -> Column:
    """MTH-07: Gaussian expansion."""
    return F.transform(F.array(*[F.lit(float(c)) for c in centers]), lambda c: F.exp(-gamma * (x - c) * (x - c)))


def distance(a: Column, b: Column) -> Column:
    """MTH-08: Euclidean, of arrays, in double."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def scaled_score(mae: Column, scale: Column) -> Column:
    """MTH-09: 1 - mae / scale."""
    return 1.0 - mae / scale


def blend(a: Column, b: Column, q: float) -> Column:
    """ARR-03: q a + (1 - q) b, exactly a at 1 and exactly b at 0."""
    return a if q == 1 else b if q == 0 else F.zip_with(a, b, lambda x, y: q * x + (1.0 - q) * y)


def triples(flat: Column) -> Column:
    """ARR-01: [x0, y0, z0, x1, ...] to points."""
    n = (F.size(flat) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, 3 * i + 1, 3))).otherwise(F.array().cast("array<array<double>>"))


def encode(x: Column, vocabulary: list[str]) -> Column:
    """ARR-02: place in vocabulary, its length for anything else or null."""
    at = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), x)
    return F.when(at.isNull() | (at == 0), len(vocabulary)).otherwise(at - 1).cast("int")


def scrub(xs: Column) -> Column:
    """ARR-05: NaN for infinities."""
    return F.transform(xs, lambda x: F.when(F.abs(x) == float("inf"), float("nan")).otherwise(x))


def electron_cap(numbers: Column, bands: list[tuple[int, int]]) -> Column:
    """MTH-11: sum over atomic numbers of the cap of the first band (up to, cap) that holds each."""

    def cap(z: Column) -> Column:
        out = F.lit(0)
        for upto, value in reversed(bands):
            out = F.when(z <= upto, value).otherwise(out)
        return out

    return F.aggregate(numbers, F.lit(0), lambda a, z: a + cap(z))


def is_flat(points: Column) -> Column:
    """FIL-14: has points and all have z = 0."""
    return (F.size(points) > 0) & F.forall(points, lambda p: p[2] == 0)


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, low: float = 0.0) -> Column:
    """WIN-16: linear to peak, then cosine to low."""
    part = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, peak * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(low + 0.5 * (peak - low) * (1 + F.cos(F.lit(3.141592653589793) * part)))


def ema(values: Column, decay: float) -> Column:
    """AGG-30: running average of an ordered array, from its first value."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: decay * a + (1 - decay) * x)
