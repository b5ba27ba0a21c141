"""Forecasts beside least squares in numpy; planted trend, season and outlier; edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import forecast as FC


def design(e, lo, hi):
    t = (e - lo) / (hi - lo) if hi > lo else np.zeros(len(e))
    cols = [np.ones(len(e)), t, *[np.maximum(t - 0.8 * j / 6, 0) for j in range(1, 6)]]
    for period, order in ((86_400, 3), (604_800, 2)):
        for k in range(1, order + 1):
            cols += [f(2 * np.pi * k * (e % period) / period) for f in (np.sin, np.cos)]
    return np.stack(cols, axis=1)


def test_beside_least_squares(spark):
    r, rows = np.random.default_rng(3), []
    for name, slope in (("a", 0.0), ("b", 5.0), ("c", -2.0)):
        e = np.sort(r.choice(24 * 28, 400, replace=False)) * 3600 + 1_700_000_000
        y = 100 + slope * np.arange(400) / 40 + 20 * np.sin(2 * np.pi * e / 86_400) + r.normal(0, 2, 400)
        rows += [(name, int(t), float(v)) for t, v in zip(e, y)]
    rows[200] = (rows[200][0], rows[200][1], 400.0)  # an outlier
    df = spark.createDataFrame(rows + [("a", rows[0][1] + 1, None)], "s string, e long, v double")
    model = FC.fit(df, ["s"], "e", "v")
    got = {r["s"]: r for r in model.collect()}
    for name in "abc":
        e, y = (np.array(x) for x in zip(*[(t, v) for s, t, v in rows if s == name]))
        x = design(e, e.min(), e.max())
        stacked = np.vstack([x, np.diag(np.sqrt(FC.PENALTIES))])
        want = np.linalg.lstsq(stacked, np.concatenate([y, np.zeros(FC.SIZE)]), rcond=None)[0]
        assert np.allclose(got[name]["coefficients"], want, atol=1e-5) and got[name]["n"] == 400
        assert got[name]["sigma"] == pytest.approx(np.sqrt(((y - x @ want) ** 2).sum() / (400 - FC.SIZE)), rel=1e-6)
    out = FC.forecast(df.filter("v is not null"), model, ["s"], "e").withColumn("d", FC.severity(F.col("v"))).orderBy(F.desc("d")).collect()
    assert out[0]["v"] == 400.0 and out[0]["d"] > 4 and sum(r["lower"] <= r["v"] <= r["upper"] for r in out) >= 0.99 * len(out)
    # a day behind the history the season goes on
    ahead = FC.forecast(spark.createDataFrame([("c", max(t for s, t, _ in rows if s == "c") + 86_400), ("?", 5)], "s string, e long"), model, ["s"], "e").collect()
    assert {r["s"]: r["expected"] is None for r in ahead} == {"c": False, "?": True}


def test_edges(spark):
    df = spark.createDataFrame([("one", 100, 7.0), ("none", 100, None), ("flat", 100, 3.0), ("flat", 100, 3.0), (None, 1, 1.0)], "s string, e long, v double")
    got = {r["s"]: r for r in FC.fit(df, ["s"], "e", "v").collect()}
    assert set(got) == {"one", "flat"} and got["one"]["sigma"] is None  # a null series or value teaches nothing
    out = FC.forecast(df, FC.fit(df, ["s"], "e", "v"), ["s"], "e").withColumn("d", FC.severity(F.col("v"))).collect()
    assert len(out) == 5 and all(r["d"] == 0.0 for r in out) and FC.fit(df.filter("false"), ["s"], "e", "v").collect() == []
    level = spark.createDataFrame([(2.5,), (4.0,), (4.1,)], "d double").select(*FC.alert_level(F.col("d"))).collect()
    assert [tuple(r) for r in level] == [("warning", "low"), ("warning", "low"), ("critical", "high")]
