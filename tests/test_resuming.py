"""Work that resumes, backups in parts, running totals: stopped, damaged and empty."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators.running import total_before
from sparkquarry.sources import backups, ledger


@pytest.fixture
def rows(spark):
    return spark.range(100).select(F.when(F.col("id") != 99, F.col("id")).alias("id"), (F.col("id") * 10).alias("v"))


def plain(attempt):
    return F.col("v") + 1, F.lit(None).cast("string")


def test_copy_goes_on(spark, tmp_path, rows):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    seen = []

    def noted(attempt):
        return plain(attempt)

    assert ledger.copy_in_ranges(rows, "id", book, noted, F.lit(0), n=10, wave=4, most=3) == 3
    part = ledger.copied(book, rows, "bigint").count()
    assert 0 < part < 100 and len(book.finished()) == 3
    # a wave that was stopped before its entry: files are there, the ledger doesn't know
    store = book.store
    lost = next(n for n in range(10) if n not in book.finished())
    spark.range(5).select(F.col("id"), F.lit(1).cast("long").alias("v"), F.lit(2).cast("long").alias("_value"), F.lit(1).alias("_attempts"), F.lit("transformed").alias("_how")).write.parquet(f"{store.root}/copied/_range={lost}")
    assert ledger.copied(book, rows, "bigint").count() == part
    # the plan stays, whatever is asked for now
    assert ledger.copy_in_ranges(rows, "id", book, noted, F.lit(0), n=3, wave=4) == len(book.ranges(rows, "id", 3)) - 3
    out = ledger.copied(book, rows, "bigint").collect()
    assert sorted((r["v"], r["_value"]) for r in out) == [(10 * i, 10 * i + 1) for i in range(100)] and sum(r["id"] is None for r in out) == 1
    assert sum(f["rows"] for f in book.finished().values()) == 100
    assert ledger.copy_in_ranges(rows, "id", book, noted, F.lit(0)) == 0 and not seen


def test_error_between_waves_loses_nothing(spark, tmp_path, rows):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    bad = lambda a: (F.when(F.col("id") >= 50, F.raise_error(F.lit("the store is down")).cast("bigint")).otherwise(F.col("v")), F.lit(None).cast("string"))
    with pytest.raises(Exception, match="the store is down"):
        ledger.copy_in_ranges(rows, "id", book, bad, F.lit(0), n=10, wave=2)
    done = len(book.finished())
    assert 0 < done < 10
    assert ledger.copy_in_ranges(rows, "id", book, plain, F.lit(0), n=10, wave=2) == len(book.ranges(rows, "id", 10)) - done
    assert ledger.copied(book, rows, "bigint").select("v").distinct().count() == 100


def test_failures_go_to_the_side(spark, tmp_path, rows):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    flaky = lambda a: (F.col("v"), F.when((F.col("id") % 10 == 0) & ((F.col("id") % 20 == 0) | F.lit(a == 0)), F.concat(F.lit("no "), F.col("id"))))
    ledger.copy_in_ranges(rows, "id", book, flaky, F.col("v") * -1, n=4, attempts=2)
    out = {r["id"]: r for r in ledger.copied(book, rows, "bigint").collect() if r["id"] is not None}
    assert (out[20]["_value"], out[20]["_how"], out[20]["_attempts"]) == (-200, "fallback", 2) and (out[10]["_value"], out[10]["_attempts"]) == (100, 2) and out[7]["_attempts"] == 1
    assert sorted(r["_error"] for r in ledger.failures(book, rows).collect()) == sorted(f"no {i}" for i in range(0, 100, 20))


def test_empty_copy_and_sums(spark, tmp_path, rows):
    book = ledger.Ledger(spark, str(tmp_path / "a"))
    assert ledger.copy_in_ranges(rows.filter("false"), "id", book, plain, F.lit(0), n=4) == 1 and ledger.copied(book, rows, "bigint").collect() == []
    book = ledger.Ledger(spark, str(tmp_path / "b"))
    partial = {"n": F.count("*"), "total": F.sum("v")}
    assert ledger.sums_in_ranges(rows, "id", book, partial, n=5, wave=2, most=2) == 2 and ledger.sums_in_ranges(rows, "id", book, partial, n=5) == 3
    assert ledger.sums(book, "n long, total long").agg(F.sum("n"), F.sum("total")).first()[:] == (100, 10 * sum(range(100)))


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 13).alias("s"))
    got = {r["k"]: (r["s"], r["b"]) for r in total_before(df, ["k"], "s", "b", per_task=90).collect()}
    at = 0
    for k in range(1000):
        assert got[k][1] == at
        at += got[k][0]
    assert total_before(df.filter("false"), ["k"], "s", "b").collect() == []


SCHEMA = "id long, v string"


@pytest.fixture
def saved(spark, tmp_path):
    df = spark.range(300).select("id", F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.lit("\n")).alias("v"))
    path = str(tmp_path / "b")
    return df, path, backups.backup_parts(df, path, "id", F.octet_length("v"), 2000)


def test_parts(spark, saved):
    df, path, manifest = saved
    at, want = 0, {}
    for r in sorted(df.collect()):
        k = want.setdefault(at // 2000, [0, 0, r["id"], r["id"]])
        size = len(r["v"].encode())
        k[0], k[1], k[3], at = k[0] + 1, k[1] + size, r["id"], at + size
    assert {r["part"]: list(r)[1:] for r in manifest.collect()} == want and len(want) > 3
    for part in want:
        assert len(glob.glob(f"{path}/data/part={part}/*.gz")) == 1
    assert sorted(map(tuple, backups.restore_parts(spark, path, SCHEMA).drop("part").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        backups.backup_parts(df, path, "id", F.octet_length("v"))


def test_damage_is_refused(spark, saved):
    _, path, _ = saved
    file = glob.glob(f"{path}/data/part=2/*.gz")[0]
    lines = gzip.open(file, "rt").read().split("\n")
    for crc in glob.glob(f"{path}/data/part=*/.*.crc"):
        os.remove(crc)  # else the local file system itself refuses
    gzip.open(file, "wt").write("\n".join([lines[0].replace("x", "y", 1) if "x" in lines[0] else lines[0] + " ", *lines[1:]]))
    with pytest.raises(ValueError, match="part 2 changed"):
        backups.restore_parts(spark, path, SCHEMA)
    os.remove(file)
    with pytest.raises(ValueError, match="part 2 missing"):
        backups.restore_parts(spark, path, SCHEMA)


def test_unfinished_backup_is_none(spark, saved, tmp_path):
    _, path, _ = saved
    os.remove(f"{path}/_COMMITTED")
    with pytest.raises(ValueError, match="no finished"):
        backups.restore_parts(spark, path, SCHEMA)
    broken = spark.range(10).select("id", F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit("a")).cast("string").alias("v"))
    other = str(tmp_path / "other")
    with pytest.raises(Exception, match="lost"):
        backups.backup_parts(broken, other, "id", F.octet_length("v"))
    assert not os.path.exists(f"{other}/data") and not os.path.exists(f"{other}/_COMMITTED")
    none = spark.range(0).select("id", F.lit("a").alias("v"))
    assert backups.backup_parts(none, other, "id", F.octet_length("v")).collect() == [] and backups.restore_parts(spark, other, SCHEMA).collect() == []
