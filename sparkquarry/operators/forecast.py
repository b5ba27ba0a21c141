"""Seasonal forecasts with intervals: a trend with change points and Fourier terms, by ridge regression for each series.

A series is reduced to the sums of its normal equations by one grouped
aggregate, so no task sees a series whole; what is solved is a matrix of
17 x 17 for each series.  The residual variance follows from the same sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY, WEEK = 86_400, 604_800
#: Change points lie evenly in this part of the history.
CHANGE_POINTS, HISTORY = 5, 0.8
#: Fourier orders.
DAILY, WEEKLY = 3, 2
#: Ridge penalties: of the slope, its changes, the seasons. The level has none.
PENALTY = {"slope": 0.01, "change": 1.0, "season": 0.1}
#: Half the width of an interval that covers 0.997, in standard deviations.
WIDTH = 2.9677379253417944

SIZE = 2 + CHANGE_POINTS + 2 * (DAILY + WEEKLY)
PENALTIES = [0.0, PENALTY["slope"], *[PENALTY["change"]] * CHANGE_POINTS, *[PENALTY["season"]] * (2 * (DAILY + WEEKLY))]


def features(second: Column, first: Column, last: Column) -> list[Column]:
    """Level, slope, changes of slope, daily and weekly terms at a time in seconds; the history runs from ``first`` to ``last``."""
    t = F.coalesce(F.try_divide((second - first).cast("double"), last - first), F.lit(0.0))
    season = [wave(2 * np.pi * k * (F.pmod(second, F.lit(period)) / period)) for period, order in ((DAY, DAILY), (WEEK, WEEKLY)) for k in range(1, order + 1) for wave in (F.sin, F.cos)]
    changes = [F.greatest(t - HISTORY * j / (CHANGE_POINTS + 1), F.lit(0.0)) for j in range(1, CHANGE_POINTS + 1)]
    return [F.lit(1.0), t, *changes, *season]


def fit(rows: DataFrame, series: list[str], second: str, value: str) -> DataFrame:
    """series, first, last, n, coefficients, sigma for each series; null values teach nothing, and sigma is null with no more points than terms."""
    ends = rows.groupBy(*series).agg(F.min(second).alias("first"), F.max(second).alias("last"))
    known = rows.filter(F.col(value).isNotNull()).join(ends, series)
    x = features(F.col(second), F.col("first"), F.col("last"))
    named = known.select(*series, "first", "last", F.col(value).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    both = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(SIZE) for j in range(i, SIZE)]
    with_y = [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(SIZE)]
    sums = named.groupBy(*series, "first", "last").agg(F.count("*").alias("n"), F.array(*both).alias("xx"), F.array(*with_y).alias("xy"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))

    @F.pandas_udf("coefficients array<double>, sigma double")
    def solved(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        upper, out = np.triu_indices(SIZE), []
        for count, a, b, c in zip(n, xx, xy, yy):
            m, b = np.zeros((SIZE, SIZE)), np.asarray(b)
            m[upper] = a
            m = m + m.T - np.diag(np.diag(m))
            found = np.linalg.solve(m + np.diag(PENALTIES), b)
            rest = c - 2 * found @ b + found @ m @ found
            out.append((found.tolist(), float(np.sqrt(max(rest, 0.0) / (count - SIZE))) if count > SIZE else None))
        return pd.DataFrame(out, columns=["coefficients", "sigma"])

    return sums.withColumn("_s", solved("n", "xx", "xy", "yy")).select(*series, "first", "last", "n", "_s.coefficients", "_s.sigma")


def forecast(rows: DataFrame, model: DataFrame, series: list[str], second: str) -> DataFrame:
    """``rows`` with expected, lower and upper; any time may be asked for, also behind the history. Rows of a series without a model have nulls."""
    j = rows.join(model.select(*series, "first", "last", "coefficients", "sigma"), series, "left")
    x = features(F.col(second), F.col("first"), F.col("last"))
    expected = sum((F.element_at("coefficients", i + 1) * c for i, c in enumerate(x[1:], 1)), F.element_at("coefficients", 1) * x[0])
    return j.withColumn("expected", expected).withColumns({"lower": F.col("expected") - WIDTH * F.col("sigma"), "upper": F.col("expected") + WIDTH * F.col("sigma")}).drop("first", "last", "coefficients", "sigma")


def severity(value: Column) -> Column:
    """How many thirds of the interval's half a value is off; 0 where the interval has no width."""
    third = (F.col("upper") - F.col("expected")) / 3
    return F.when(third > 1e-9, F.abs(value - F.col("expected")) / third).otherwise(0.0)


def alert_level(deviations: Column) -> tuple[Column, Column]:
    """Severity and urgency of an anomaly: more than four deviations are critical and urgent."""
    critical = deviations > 4
    return F.when(critical, "critical").otherwise("warning"), F.when(critical, "high").otherwise("low")
