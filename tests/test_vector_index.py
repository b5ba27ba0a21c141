"""Vector search beside brute force: clustered, copied, scattered and degenerate vectors."""

import numpy as np
import pytest

from sparkquarry.operators import vector_index as VI


def table(spark, seed=5, n=400, clusters=12, dim=16):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(clusters, dim))
    x = mid[r.integers(0, clusters, n)] + r.normal(scale=0.25, size=(n, dim))
    x[30:60] = x[7]  # copies
    x[60:70] = r.normal(size=(10, dim))
    rows = [(i, [float(a) for a in np.float32(v)], int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000, [0.0] * dim, 0), (1001, None, 1), (1002, [float(a) for a in np.float32(-x[7])], 0), (1003, [float(a) for a in np.float32(3 * x[8])], 2)]
    return rows, spark.createDataFrame(rows, "k long, v array<float>, g int")


def cosines(rows):
    good = [(k, np.array(v, float), g) for k, v, g in rows if v is not None and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    return [k for k, _, _ in good], [g for _, _, g in good], x @ x.T


@pytest.mark.parametrize("least,centres", [(0.9, None), (0.98, 1), (0.6, 40)])
def test_pairs(spark, least, centres):
    rows, df = table(spark)
    index = VI.build(df, "k", "v", None if centres is None else VI.fit_centres(df, "k", "v", centres))
    for same in ([], ["g"]):
        ids, group, c = cosines(rows)
        want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j] and c[i, j] >= least and (not same or group[i] == group[j])}
        edge = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids)) if abs(c[i, j] - least) < 1e-9}
        got = [(r["a"], r["b"]) for r in VI.pairs_within(index, "k", least, same).collect()]
        assert len(got) == len(set(got)) and set(got) ^ want <= edge and len(want) > 400 / (1 + 2 * len(same))


@pytest.mark.parametrize("probes", [1, 4])
def test_top(spark, probes):
    rows, df = table(spark)
    index = VI.build(df, "k", "v")
    ids, group, c = cosines(rows)
    for same in ([], ["g"]):
        got = {}
        for r in VI.top_matches(index, df.filter("k % 7 = 0 or k > 999"), "k", 6, same, probes).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["match_id"], r["score"]))
        for i, k in enumerate(ids):
            if k % 7 and k <= 999:
                continue
            others = sorted((-round(float(c[i, j]), 6), ids[j]) for j in range(len(ids)) if j != i and (not same or group[i] == group[j]))[:6]
            found = sorted(got[k])
            assert [r for r, _, _ in found] == list(range(1, 7)) and np.allclose([s for *_, s in found], [-s for s, _ in others], atol=2e-6)
            if len({s for s, _ in others}) == 6 and min(np.diff([s for s, _ in others])) > 1e-5:
                assert [m for _, m, _ in found] == [m for _, m in others]
        assert 1000 not in got and 1001 not in got


def test_recall(spark):
    _, df = table(spark, n=900)
    index = VI.build(df, "k", "v")
    queries = df.filter("k % 9 = 0")
    true = VI.top_matches(index, queries, "k", 10)
    probes = VI.probes_for(index, "k", 10)
    assert probes < len(index.centres)
    assert VI.recall(VI.top_matches(index, queries, "k", 10, probes=probes, exact=False), true).first()[0] >= 0.9
    assert VI.recall(true, true).first()[0] == 1.0


def test_empty(spark):
    _, df = table(spark, n=80)
    none = df.filter("false")
    index = VI.build(none, "k", "v")
    assert VI.pairs_within(index, "k", 0.9).collect() == [] and VI.top_matches(index, df, "k", 3).collect() == []


def test_no_row_for_each_pair(spark):
    """Queries and members meet as matrices: the plan has no join by cell, whose rows would be pairs."""
    _, df = table(spark)
    index = VI.build(df, "k", "v")
    plan = VI.top_matches(index, df.filter("k % 7 = 0"), "k", 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "_cell" in plan and "Inner" not in plan
    assert "GroupsInPandas" in VI.pairs_within(index, "k", 0.9, ["g"])._jdf.queryExecution().optimizedPlan().toString()


def test_centres_of_a_sample(spark, monkeypatch):
    """More rows than the sample: neither sorted with a limit nor collected row by row."""
    from pyspark.sql.classic.dataframe import DataFrame

    _, df = table(spark)
    monkeypatch.setattr(DataFrame, "orderBy", None)
    monkeypatch.setattr(DataFrame, "collect", None)
    assert VI.fit_centres(df, "k", "v", sample=100).shape == (20, 16)


def test_many_equal_scores(spark, monkeypatch):
    """Copies over several slices and blocks: ties go to the smallest keys."""
    monkeypatch.setattr(VI, "SLICE", 300)
    monkeypatch.setattr(VI, "BLOCK", 40)
    x = np.float32(np.random.default_rng(3).normal(size=(5, 8)))
    rows = [(i, [float(a) for a in x[i % 5]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = VI.top_matches(VI.build(df, "k", "v"), df.filter("k >= 1300"), "k", 3).collect()
    assert len(got) == 600 and all(r["score"] == 1.0 and r["match_id"] == r["query_id"] % 5 + 5 * (r["rank"] - 1) for r in got)
