"""Buffers, silence and incidents on event-time timers: what is kept, what is let go, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkquarry.streaming import timers, windows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def run(spark, tmp_path):
    """Feeds batches, each one run of the stream from its checkpoint; gives the rows written and the state rows that are left."""

    def go(make, batches):
        left = None
        for i, rows in enumerate(batches):
            spark.createDataFrame([(n, k, at(s), v) for n, k, s, v in rows], "event_id long, key string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = make(windows.read_events(spark, f"{tmp_path}/in", "event_id long, key string, ts timestamp, value double", 1000))
            query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
            left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").drop("batch").collect()], left

    return go


FAR = [(999, "end", 10_000_000, 0.0)]


def test_buffer(run):
    batches = [
        [(1, "a", 0, 0.0), (2, "a", 1, 0.0), (3, "a", 2, 0.0), (4, "b", 2, 0.0), (5, "a", 6, 0.0)],
        [(6, "a", 7, 0.0), (7, "a", 8, 0.0), (8, "a", 8.5, 0.0), (9, "b", 9, 0.0)],
        FAR,
    ]
    rows, left = run(lambda s: timers.buffered(s, "key", "event_id", most=3, seconds=5), batches)
    assert sorted(rows) == [
        ("a", at(0), 0, 3, "count", [1, 2, 3]), ("a", at(5), 0, 3, "count", [5, 6, 7]), ("a", at(5), 1, 1, "time", [8]),
        ("b", at(0), 0, 1, "time", [4]), ("b", at(5), 0, 1, "time", [9]),
    ]
    assert left == 1  # of the last event's key alone


def test_buffer_of_hundreds(run):
    batches = [[(i, "a", i * 0.001, 0.0) for i in range(250)], FAR]
    rows, _ = run(lambda s: timers.buffered(s, "key", "event_id"), batches)
    assert sorted((r[2], r[3], r[4]) for r in rows) == [(0, 100, "count"), (1, 100, "count"), (2, 50, "time")] and sorted(sum((r[5] for r in rows), [])) == list(range(250))


def test_late_event_joins_the_open_buffer(run):
    rows, _ = run(lambda s: timers.buffered(s, "key", "event_id", most=9, seconds=5, delay="1 hour"), [[(1, "a", 7, 0.0)], [(2, "a", 1, 0.0), (3, "a", 9, 0.0)], FAR])
    assert rows == [("a", at(5), 0, 3, "time", [1, 2, 3])]


def test_lines_of_a_flush(spark):
    df = spark.createDataFrame([("a", [3, 1])], "key string, events array<long>")
    assert [r[0] for r in timers.flushed_lines(df).collect()] == ['{"value":3}', '{"value":1}']


def test_silence_is_forgotten(run):
    batches = [[(1, "a", 0, 0.0), (2, "a", 9, 0.0), (3, "b", 5, 0.0)], [(4, "a", 9.5, 0.0), (5, "a", 10, 0.0), (6, "a", 19.9, 0.0)], [(7, "a", 400, 0.0), (8, "c", 400, 0.0)], FAR]
    rows, left = run(lambda s: timers.cooldown(s, "key", 10, "0 seconds"), batches)
    assert sorted(r[0] for r in rows) == [1, 3, 5, 7, 8, 999] and left == 1


def test_incidents_expire(run):
    batches = [
        [(1, "a", 0, 1.0), (2, "a", 100, 5.0), (3, "a", 399, 2.0), (4, "b", 0, 1.0)],  # a: one incident, b: one
        [(5, "a", 800, 1.0), (6, "c", 900, 0.0)],  # again within memory
        [(7, "b", 90_000, 3.0)],  # after a day: forgotten
        [(8, "a", 86_400 + 1_050, 7.0)],  # late by a wide margin, dropped as the watermark is past it
        FAR,
    ]
    rows, left = run(lambda s: timers.incidents(s, "key", "value", 300, 86_400), batches)
    assert sorted(r for r in rows if r[0] != "end") == [
        ("a", at(0), at(399), 3, 5.0, 1), ("a", at(800), at(800), 1, 1.0, 2), ("b", at(0), at(0), 1, 1.0, 1), ("b", at(90_000), at(90_000), 1, 3.0, 1), ("c", at(900), at(900), 1, 0.0, 1),
    ]
    assert left == 1


def test_state_falls_to_none(run):
    many = [(i, f"k{i}", i * 0.01, 1.0) for i in range(300)]
    rows, left = run(lambda s: timers.incidents(s, "key", "value", 60, 600), [many, [(900, "x", 100, 1.0)], [(901, "x", 900, 1.0)], FAR])
    assert left == 1 and len([r for r in rows if r[0] != "x"]) == 300


def test_empty_stream(run):
    rows, _ = run(lambda s: timers.cooldown(s, "key", 10, "0 seconds"), [[], FAR])
    assert [r[0] for r in rows] == [999]


def test_rows_of_a_key_without_frames():
    """Parts of a key's rows come as arrays, by time and then number; a call that has nothing to say makes no frame."""
    import numpy as np
    import pandas as pd

    from sparkquarry.streaming import timers

    at = pd.to_datetime(["2024-01-01 00:00:02", "2024-01-01 00:00:01", "2024-01-01 00:00:01"]).astype("datetime64[ns]")
    rows = pd.DataFrame({"ts": at, "event_id": [5, 9, 7], "value": [0.5, 0.9, 0.7]})
    for parts in ([rows], [rows.iloc[:1], rows.iloc[1:]]):
        us, ids, values = timers._sorted(iter(parts), "event_id", "event_id", "value")
        assert ids.tolist() == [7, 9, 5] and values.tolist() == [0.7, 0.9, 0.5] and np.diff(us).tolist() == [0, 1_000_000]
