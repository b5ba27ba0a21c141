"""Importance resampling beside plain counting over a whole table, and its edges."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import resample
from sparkquarry.llm.queries import op11_importance_resample

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, most=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % most for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20, most=10_000, seed=42):
    s, t = np.zeros(most, int), np.zeros(most, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in buckets(x, most):
                counts[b] += 1
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (s.sum() + most)) / ((s[b] + 1.0) * (t.sum() + most)))) for b in range(most)]
    rows = []
    for i, x in docs:
        f = buckets(x, most)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = int(sum(gain[b] for b in f))
        rows.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0], r[1:4]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_features():
    texts = ["Hello  World, ÀB c1_2", "", "x", "é" * 70_000 + " b " + "Q" * 300, "a\x00b\x7fc 0Z", "one two"]
    row, bucket, n = resample.FeatureHasher(10_000)(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(bucket[row == i].tolist()) == sorted(buckets(t)) and n[i] == len(words(t))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(op11_importance_resample(spark, SF)) == sorted((r[:1] + r[2:] for r in plain([tuple(r) for r in docs], target)), key=repr)


@pytest.mark.parametrize("per_bin,per_cell", [(1, 1), (3, 2), (1000, 1000)])
def test_ties_and_edges(spark, per_bin, per_cell):
    long = " ".join(f"w{i % 50}" for i in range(40_000))
    docs = [(7, "a b c d")] * 9 + [(i, "a b c d") for i in range(20)] + [(None, "x y z a")] * 3 + [(50, None), (51, ""), (52, long), (53, "é ü a b " * 3), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rid", "score", "rank", "bin", "cell", "n", "before")})
    target = spark.createDataFrame([("a b",), (None,), ("É x",)], "text string").withColumn("bucket", F.lit(1))
    found = resample.importance_resample(df, target, percent=60, least_words=3, buckets=97, per_bin=per_bin, per_cell=per_cell)
    assert got(found) == plain(docs, ["a b", None, "É x"], 60, 3, 97)
    assert resample.importance_resample(df.filter("false"), target).collect() == []
    assert got(resample.importance_resample(df, target.filter("false"), 60, 3, 97)) == plain(docs, [], 60, 3, 97)
    assert {r[5] for r in got(resample.importance_resample(df, target, 0, 3, 97))} == {None}


def test_hot_score_is_numbered_in_cells(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("score"), (F.col("id") * 3).alias("rid")).unionByName(spark.range(100).select(F.col("id").alias("score"), F.col("id").alias("rid")))
    found = {(r["score"], r["rid"]): r["rank"] for r in resample.ranked(rows, 3000, per_bin=10, per_cell=64).collect()}
    want = sorted(found, key=lambda x: (-x[0], x[1]))
    assert [found[x] for x in want] == [i + 1 if i < 3000 else None for i in range(len(want))] and len(want) == 5100
