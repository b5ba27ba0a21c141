"""The commit log: races, conflicts, dead writers, reverts, bases and locks."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkquarry.sources.commits import CommitLog, Conflict
from sparkquarry.sources.storage import Storage, exclusive

SCHEMA = "k long, v string"


def log_of(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"), SCHEMA, "k")
    log.commit(log.write(spark.range(6).select(F.col("id").alias("k"), F.lit("0").alias("v"))))
    return log


def state(log, version=None):
    return {r["k"]: r["v"] for r in log.snapshot(version).collect()}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_conflict_is_seen_and_retried(spark, tmp_path):
    log = log_of(spark, tmp_path)
    a, b, c = log.write(rows(spark, (1, "a"), (2, "a"))), log.write(rows(spark, (2, "b"))), log.write(rows(spark, (5, "c")), rows(spark, (3, "")))
    assert log.commit(a) == 2
    with pytest.raises(Conflict):
        log.commit(b)
    assert log.commit(c) == 3  # other keys: no conflict
    assert log.apply(lambda now: (now.filter("k = 2").withColumn("v", F.concat("v", F.lit("b"))), None)) == 4
    assert state(log) == {0: "0", 1: "a", 2: "ab", 4: "0", 5: "c"} and state(log, 2) == {0: "0", 1: "a", 2: "a", 3: "0", 4: "0", 5: "0"}


def test_writers_at_the_same_time(spark, tmp_path):
    """Four writers add a letter to the same row: each must show."""
    log, errors = log_of(spark, tmp_path), []

    def work(letter):
        try:
            CommitLog(spark, log.store.root, SCHEMA, "k").apply(lambda now: (now.filter("k = 0").withColumn("v", F.concat("v", F.lit(letter))), None), retries=20)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(x,)) for x in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(state(log)[0]) == list("0abcd") and log.latest() == 5


def test_just_one_creates(spark, tmp_path):
    store, won = Storage(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if store.create("d/x.json", str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.read("d/x.json") == str(won[0]) and store.names("d") == ["x.json"]


def test_writer_that_dies_between_data_and_manifest(spark, tmp_path):
    log = log_of(spark, tmp_path)
    lost = log.write(rows(spark, (1, "lost")))  # and nothing more
    assert state(log)[1] == "0" and log.latest() == 1
    assert log.apply(lambda now: (rows(spark, (1, "next")), None)) == 2
    assert log.vacuum(older=3600) == [] and log.vacuum(older=0) == [lost.name]
    assert state(log)[1] == "next"


def test_part_of_a_manifest_is_never_seen(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.store._write("log/.000000000002.json-x", '{"kind": "cha')  # a writer that died while it wrote
    assert log.latest() == 1 and log.commit(log.write(rows(spark, (1, "a")))) == 2


def test_revert_and_base(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.commit(log.write(rows(spark, (1, "a"))))
    log.commit(log.write(rows(spark, (2, "b")), rows(spark, (0, ""))))
    before = log.write(rows(spark, (4, "x")))
    assert log.revert(3) == 4 and state(log) == {0: "0", 1: "a", 2: "0", 3: "0", 4: "0", 5: "0"} and state(log, 3)[2] == "b"
    with pytest.raises(Conflict):
        log.commit(before)  # made from what was taken back
    assert log.compact() == 5 and state(log)[1] == "a" and len(log.visible()) == 1
    log.commit(log.write(rows(spark, (1, "z"))))
    assert state(log)[1] == "z" and state(log, 2) == {0: "0", 1: "a", 2: "0", 3: "0", 4: "0", 5: "0"}
    for v in (1, 4, 5, 99):
        with pytest.raises(ValueError):
            log.revert(v)


def test_empty_table(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "none"), SCHEMA, "k")
    assert state(log) == {} and log.latest() == 0 and log.vacuum(0) == []


def test_lock(spark, tmp_path):
    store = Storage(spark, str(tmp_path))
    with exclusive(store, "lock"):
        with pytest.raises(TimeoutError):
            with exclusive(store, "lock", timeout=0.3):
                pass
    with exclusive(store, "lock", timeout=0.3):
        pass
    store.create("lock", "dead")
    time.sleep(0.2)
    with exclusive(store, "lock", timeout=5, stale=0.1):
        assert store.read("lock") != "dead"
    assert not store.exists("lock")
