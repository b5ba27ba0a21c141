"""Filters that can't be widened, owners of keys, exclusion windows that overlap, places of many matches, roles in dense hierarchies."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import access as AC
from sparkquarry.operators import alerts as A
from sparkquarry.operators import pii as P


def test_filters(spark):
    df = spark.createDataFrame([(1, "public", "en"), (2, "secret", "en"), (3, None, "en"), (4, "public", None)], "id long, level string, `lang.x` string")
    ids = lambda server, client: sorted(r["id"] for r in AC.secured(df, server, client).collect())
    server = {"level": {"$in": ["public"]}}
    assert ids(server, None) == ids(server, {}) == [1, 4]
    for client in ({"level": "secret"}, {"level": {"$in": ["secret", "public"]}, "lang.x": {"$eq": "en"}}, {"$and": [{"level": {"$eq": "public"}}, {"lang.x": "en"}]}):
        assert set(ids(server, client)) <= {1, 4}
    assert ids(server, {"$and": [{"level": {"$eq": "public"}}, {"lang.x": "en"}]}) == [1] and ids({}, {"level": "secret"}) == [2]
    for bad in ({"level": {"$ne": "x"}}, {"$or": []}, {"level": {"$eq": 1, "$in": []}}):
        with pytest.raises(ValueError):
            AC.metadata_filter(bad)


def test_key_owners(spark):
    users = spark.createDataFrame([("k1", 1, True), ("k2", 2, False), ("k3", 3, None)], "key string, user_id long, active boolean").select(F.sha2("key", 256).alias("h"), "user_id", "active")
    requests = spark.createDataFrame([(i, k) for i, k in enumerate(["k1", "k2", "k3", "no", None])], "id int, key string")
    assert {r["id"]: r["user_id"] for r in AC.key_owners(requests, users, "key", "h", "active").collect()} == {0: 1, 1: None, 2: None, 3: None, 4: None}


def test_dense_hierarchy(spark):
    """All of 12 roles inherit all later ones: some two thousand ways, 66 pairs."""
    n = 12
    edges = spark.createDataFrame([(f"r{i:02}", f"r{j:02}") for i in range(n) for j in range(i + 1, n)], "role string, inherits string")
    got = AC.role_closure(spark, edges, edges.select("role").distinct()).collect()
    assert len(got) == n - 1 + n * (n - 1) // 2 and max(r["steps"] for r in got) == 1 and AC.role_cycles(spark, edges).collect() == []
    back = edges.union(spark.createDataFrame([("r11", "r00"), ("x", "x")], edges.schema))
    cycles = {r["role"]: r["cycle"] for r in AC.role_cycles(spark, back).collect()}
    assert len(cycles) == n + 1 and cycles["r00"] == "r00>r11>r00" and cycles["r05"] == "r05>r11>r00>r05" and cycles["x"] == "x>x"
    assert AC.role_closure(spark, edges.filter("false"), edges.select("role").distinct().limit(1)).count() == 1


def test_windows_that_overlap(spark):
    at = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    windows = [(at(1, 22), at(3, 2)), (at(2, 5), at(2, 6)), (at(3, 1), at(3, 4)), (at(5, 0), at(5, 0)), (at(6, 9), at(6, 8)), (at(7, 0), at(8, 0))]
    points = [at(d, h, m) for d in range(1, 10) for h in range(24) for m in (0, 30)]
    df = spark.createDataFrame([(p, 4.0) for p in points], "t timestamp_ntz, severity double")
    got = {r["t"]: r["is_anomaly"] for r in A.with_exclusions(df, spark.createDataFrame(windows, "start_at timestamp_ntz, end_at timestamp_ntz"), "t", 3.0, 5.0).collect()}
    assert len(got) == len(points) and all(got[p] == (not any(a <= p < b for a, b in windows)) for p in points)
    none = spark.createDataFrame([], "start_at timestamp_ntz, end_at timestamp_ntz")
    assert A.with_exclusions(df, none, "t", 3.0, 5.0).filter("not is_anomaly").isEmpty()


def test_places_of_many_matches(spark):
    text = "é 😀 " + "".join(f"write to u{i}@mail{i % 3}.org or EMP-{i:05}, " for i in range(700))
    rows = [(1, text), (2, ""), (3, None), (4, "EMP-12345"), (5, "a@b.co" * 3)]
    got = sorted((r["doc_id"], r["entity"], r["start_at"], r["end_at"], r["match"]) for r in P.spans(spark.createDataFrame(rows, "doc_id long, text string"), entities=("EMPLOYEE_ID", "EMAIL_ADDRESS")).collect())
    patterns = [(e, p) for e, p, _ in P.PATTERNS if e in ("EMPLOYEE_ID", "EMAIL_ADDRESS")]
    assert got == sorted((d, e, m.start(), m.end(), m.group()) for d, t in rows for e, p in patterns for m in re.finditer(p, t or "", re.ASCII))
    assert len(got) > 1400


def test_scores_of_empty_texts(spark):
    from sparkquarry.functions import text as T

    rows = [("",), ("   ",), (None,), ("One two three.",), ("é è.",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", T.readability_score(F.col("t")).alias("r"), T.completeness_score(F.col("t")).alias("c"), T.density_score(F.col("t")).alias("d")).collect()
    by = {r["t"]: r for r in got}
    assert by[""]["r"] == by["   "]["r"] == 0.0 and by[""]["c"] == 0.0 and by["One two three."]["r"] == 90.0 and by["é è."]["r"] == (80 + 50) / 2
