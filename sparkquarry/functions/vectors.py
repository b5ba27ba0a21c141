"""Vector expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def truncated(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


def laplace_noise(v: Column, key: Column, epsilon: float) -> Column:
    """Laplace noise of scale 1 / epsilon, drawn from a hash of the key and the position."""

    def noisy(x: Column, i: Column) -> Column:
        u = F.pmod(F.xxhash64(key, i), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 0.5
        return x.cast("double") - F.signum(u) / epsilon * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))

    return F.transform(v, noisy)
