"""Sources, queues, golden sets and lifecycle on hand-made rows."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import access as AC
from sparkquarry.operators import experiments as X
from sparkquarry.operators import lifecycle as L
from sparkquarry.operators import monitoring as M
from sparkquarry.operators import pii as P
from sparkquarry.sources import golden as G
from sparkquarry.sources import queues as Q
from sparkquarry.sources import tables as TB
from sparkquarry.streaming import windows as ST


def test_relational_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    TB.append_table(spark.range(100).select("id", (F.col("id") * 2).alias("v")), url, "POINTS")
    TB.append_table(spark.range(100, 120).select("id", (F.col("id") * 2).alias("v")), url, "POINTS")
    got = TB.read_table(spark, url, "POINTS", column="ID", low=0, high=120, parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.filter("ID >= 50").agg(F.sum("V"), F.count("*")).first()[:] == (sum(2 * i for i in range(50, 120)), 70)


def test_queue(spark, tmp_path):
    calls = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    Q.enqueue(calls, f"{tmp_path}/q")
    spark.createDataFrame([("no json",), ('{"id": 3}',)], "value string").write.mode("append").text(f"{tmp_path}/q")
    Q.consume(Q.queue(spark, f"{tmp_path}/q", "id long, name string", files=1), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["id"], r["name"]) for r in got if r["_corrupt"] is None} == {(1, "a"), (2, "b"), (3, None)}
    assert [r["_corrupt"] for r in got if r["id"] is None] == ["no json"]


def test_golden_sets(spark, tmp_path):
    items = spark.createDataFrame([("q1", "a"), ("q2", "b")], "question string, answer string")
    G.save(items, str(tmp_path), "set", "v1")
    assert sorted(map(tuple, G.load(spark, str(tmp_path), "set", "v1", "question string, answer string").collect())) == [("q1", "a"), ("q2", "b")]
    with pytest.raises(Exception, match="duplicate question"):
        G.save(items.unionByName(items), str(tmp_path), "set", "v2")
    with pytest.raises(Exception, match="(?i)exists"):
        G.save(items, str(tmp_path), "set", "v1")


def test_places_of_personal_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "é a@b.cd, x.y@z.org 123-45-6789 EMP-12345"), (-2, ""), (-3, None)], "doc_id long, text string")
    df = docs.unionByName(more)
    got = {tuple(r[:4]) for r in P.spans(df).select("doc_id", "entity", "start_at", "end_at").collect()}
    want = {(r["doc_id"], e, m.start(), m.end()) for r in df.collect() for e, p, _ in P.PATTERNS for m in re.finditer(p, r["text"] or "", re.ASCII if "\\b" not in p else 0)}
    assert got == want


def test_deletion_is_verified(spark):
    t = spark.range(5)
    gone = t.filter("id < 2")
    assert L.delete_verified(t, gone, ["id"], t.filter("id >= 2")).count() == 3
    for left, said in ((t, "still there"), (t.filter("id > 2"), "missing")):
        with pytest.raises(Exception, match=said):
            L.delete_verified(t, gone, ["id"], left).collect()


def test_long_role_chains(spark):
    edges = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(150)], "role string, inherits string")
    got = AC.role_closure(spark, edges, spark.createDataFrame([("r0",)], "role string"))
    assert got.count() == 151


def test_bootstrap(spark):
    rows = [(i, "control" if i % 2 else "treatment", float(i % 7) + (0 if i % 2 else 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, variant string, value double")
    low, high = X.bootstrap_interval(df).first()
    mean = lambda a: sum(v for _, x, v in rows if x == a) / 1000
    assert low < mean("treatment") - mean("control") < high and 0.25 < high - low < 0.45
    assert X.bootstrap_interval(df.repartition(7)).first()[:] == pytest.approx((low, high))


def test_drift_verdicts(spark):
    tests = spark.createDataFrame([(1, "quality_score", 0.4, 0.001), (1, "chunk_length", 0.3, 0.2), (1, "information_density", 0.2, 0.01), (2, "quality_score", 0.1, 0.001)], "batch int, metric string, statistic double, p double")
    means = spark.createDataFrame([(1, "quality_score", 80.0, 60.0), (1, "chunk_length", 100.0, 200.0), (1, "information_density", 50.0, 40.0), (2, "quality_score", 80.0, 79.0)], "batch int, metric string, baseline double, current double")
    got = {r["batch"]: r for r in M.drift_verdicts(tests, means).collect()}
    assert got[1]["has_drift"] and got[1]["affected_metrics"] == "information_density,quality_score" and got[1]["recommendations"] == "quality_degraded" and (got[1]["drift_score"], got[1]["p_value"]) == (0.4, 0.001)
    assert not got[2]["has_drift"] and got[2]["recommendations"] == ""


def test_routing(spark):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s)
    alerts = spark.createDataFrame([("a", at(s)) for s in (0, 10, 30, 31, 200, 330, 331, 1000)], "alertname string, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((r["slot"], r["n_alerts"]) for r in M.routed(alerts, ["alertname"]).collect())
    assert got == [(0, 3), (1, 3), (2, 1), (4, 1)]


def test_exposition_escapes(spark):
    df = spark.createDataFrame([('a"b\\c\nd', 2)], "k string, value int")
    assert M.exposition(df, "m", ["k"]).first()[0] == 'm{k="a\\"b\\\\c\\nd"} 2'


def test_stream_dedup_over_batches(spark, tmp_path):
    """A key comes once over several batches as long as the watermark has not passed it."""
    for n, rows in enumerate([[(1, 0), (2, 10)], [(1, 60), (3, 70)], [(2, 120), (4, 130)]]):
        spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = ST.read_events(spark, f"{tmp_path}/in/*", "k long, ts timestamp")
    out = ST.drain(ST.deduplicated(stream, ["k"]), f"{tmp_path}/s", "append")
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3, 4]
