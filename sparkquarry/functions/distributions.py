"""Distribution functions as column expressions, without a statistics library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Rational approximation of the complementary error function (Abramowitz and Stegun 7.1.26 in Chebyshev form, relative error 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    value = t * F.exp(-z * z + poly)
    return F.when(x >= 0, value).otherwise(2 - value)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    return 0.5 * erfc(z / F.lit(2.0**0.5))


def log_gamma(x: Column) -> Column:
    """For x of 0.5 or more."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + 7.5
    return 0.5 * F.ln(F.lit(2 * 3.141592653589793)) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def _beta_fraction(a: Column, b: Column, x: Column, terms: int = 120) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    state = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        e = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / safe(1 + e * s["d"])
        c = safe(1 + e / s["c"])
        h = s["h"] * d * c
        o = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2 = 1 / safe(1 + o * d)
        c2 = safe(1 + o / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), state, step, lambda s: s["h"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; a and b of 0.5 or more."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x) / b)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, F.lit(0.5), df / (df + t * t))


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * j * j * lam * lam))
    return F.when(d <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))
