"""Rounding beside Python's, exact sums beside fsum, a histogram's lines."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquarry.functions import rounding, udfs
from sparkquarry.operators import monitoring


def test_rounding(spark):
    r = random.Random(2)
    x = [0.0, -0.0, 2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.5, 1.5, 2.5, 1e-320, 5e-324, 1e300, 2.0**45, 2.0**45 - 0.125, math.inf, -math.inf, 0.285, 1.115, 9.995, 0.045]
    x += [r.uniform(-1000, 1000) for _ in range(2000)] + [r.randrange(-80_000, 80_000) / 16 for _ in range(2000)] + [r.randrange(10**9) / 1000 for _ in range(2000)] + [(r.randrange(10**6) + 0.5) / 100 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (math.nan,)], "x double")
    for digits in range(6):
        for v, got in df.select("x", rounding.round_half_even(F.col("x"), digits)).collect():
            want = v if v is None or not math.isfinite(v) else round(v, digits)
            assert got == want or (v is not None and math.isnan(v) and math.isnan(got)), (v, digits)
    with pytest.raises(ValueError):
        rounding.round_half_even(F.col("x"), 6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=30))
def test_partial_sums_are_exact(values):
    import pandas as pd

    part = udfs.exact_partial.func(pd.Series(values, dtype=float))
    assert Fraction(int(part, 16), 1 << udfs.UNIT_BITS) == sum(map(Fraction, values), Fraction(0))


def test_exact_sums_of_any_dealing(spark):
    udfs.register(spark)
    r = random.Random(1)
    x = [r.uniform(-1, 1) * 10.0 ** r.randrange(-12, 16) for _ in range(5000)]
    spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(None, None)], "i long, v double").createOrReplaceTempView("exact_rows")
    for n in (1, 7, 64):
        got = spark.sql(f"SELECT exact_total(collect_list(p)) FROM (SELECT exact_partial(v) AS p FROM exact_rows GROUP BY pmod(hash(i), {n}))").first()[0]
        assert got == math.fsum(x)
    assert spark.sql("SELECT exact_total(collect_list(p)) FROM (SELECT exact_partial(v) AS p FROM exact_rows WHERE false GROUP BY i)").first()[0] == 0.0


def test_histogram(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 1.0), ("a", 7.25), ("a", None), ("a", 100.0)], "k string, value double")
    lines = [r["line"] for r in monitoring.histogram_exposition(df, "m", "what it is", ["k"], (1.0, 10.0)).orderBy("position").collect()]
    assert lines == [
        "# HELP m what it is", "# TYPE m histogram",
        'm_bucket{k="a",le="1"} 1', 'm_bucket{k="a",le="10"} 2', 'm_bucket{k="a",le="+Inf"} 3', 'm_sum{k="a"} 108.250000', 'm_count{k="a"} 3',
        'm_bucket{k="b",le="1"} 1', 'm_bucket{k="b",le="10"} 1', 'm_bucket{k="b",le="+Inf"} 1', 'm_sum{k="b"} 0.500000', 'm_count{k="b"} 1',
    ]
    assert monitoring.histogram_exposition(df.filter("false"), "m", "x", ["k"], (1.0,)).count() == 2
