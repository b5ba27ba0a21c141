"""The pipeline on small tables: nulls, repeated rows, ties, clashing names, empty tables; steps that go."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquarry.llm import common

WORDS = "the quick brown fox jumps over a lazy dog while seven grey cats watch from the old garden wall and nobody says a word about it until night"
OTHER = "rain fell on the harbour all week so the boats stayed in and the crews mended nets told stories and waited for a better wind to come"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf_dir with documents of one language, some of them twice, and a benchmark item of ten words that one of them holds."""
    path = str(tmp_path_factory.mktemp("pipe"))
    leak = "item words one two three four five six seven eight"
    rows = [(i, f"{WORDS} {OTHER} number {'abcdefghij'[i]} {WORDS.split()[i]} {OTHER.split()[i]} {' '.join(OTHER.split()[i::3])}", "en", "web", 9) for i in range(10)]
    rows += [(20, OTHER + " " + " ".join(reversed(WORDS.split())), "en", "web", 1), (20, OTHER + " " + " ".join(reversed(WORDS.split())), "de", "web", 1)]
    rows += [(21, OTHER + " " + " ".join(reversed(WORDS.split())), "en", "web", 1), (None, "my garden and the harbour are old and grey and seven boats come in at night", "en", None, None)]
    rows += [(30, None, None, None, None), (31, "", "en", "web", 0), (32, "12345 67890 " * 9, "en", "web", 0), (33, f"{' '.join(OTHER.split()[::2])} {leak}", "en", "web", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("x") for c in ("_rid", "_h", "_nth", "row", "rid", "h", "e", "nth", "a.b")})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, path), name)
        assert after.columns == docs.columns
        assert after.exceptAll(docs).isEmpty()  # rows come out as they went in
        yield name, docs, after
        docs = after


def test_stages(spark, folder):
    ids = lambda df: sorted(r["doc_id"] or -1 for r in df.select("doc_id").collect())
    kept = {name: after for name, _, after in stages(spark, folder)}
    assert not {30, 31, 32} & set(ids(kept["language"])) and ids(kept["language"]).count(20) == 2 and -1 in ids(kept["language"])
    assert ids(kept["exact_dedup"]).count(20) == 0 and ids(kept["exact_dedup"]).count(21) == 1
    assert 33 in ids(kept["near_dedup"]) and 33 not in ids(kept["decontaminate"])
    got = corpus_pipeline.run(spark, folder)
    assert ids(got) == ids(kept["decontaminate"]) and all(r["lossless"] for r in got.collect())


def test_repeated_row_that_stays(spark, folder):
    """Of rows alike in id and text the first by the other columns stays, in whatever order they come."""
    rows = [(20, "twin", "en"), (20, "twin", "de"), (20, "twin", None), (20, "twin", "de")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").withColumn("m", F.create_map(F.lit("a"), "lang"))
        kept = df.select(F.col("doc_id").alias("rid"), F.xxhash64("text").alias("h"))
        assert [r["lang"] for r in common.keep_rows(df, kept, once=True).collect()] == [None]
        assert common.keep_rows(df, kept).count() == 4


def test_source_that_was_rejected_goes(spark):
    df = spark.createDataFrame([(1, "same", "a"), (1, "same", "b")], "doc_id long, text string, source string")
    kept = df.filter("source = 'a'").select(F.col("doc_id").alias("rid"), F.xxhash64("text").alias("h"), F.xxhash64("source").alias("e"))
    assert [r["source"] for r in common.keep_rows(df, kept, e=F.xxhash64("source")).collect()] == ["a"]


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_steps_go(spark, folder):
    top = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    with common.temporary():
        assert corpus_pipeline.run(spark, folder).count() > 0
        assert {x.split("-")[0] for x in set(os.listdir(top)) - before} == {"decontaminate"}
    assert set(os.listdir(top)) == before
