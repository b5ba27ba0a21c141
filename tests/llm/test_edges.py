"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns: one defined result for each operator."""

import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import decontaminate, exact_dedup, language, minhash, pii, piece_codec, quotation, sharding, suffix_dedup, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "x y z"), (None, None), (4, LONG), (5, LONG + "end"), (6, "a b c d e"), (7, "é " * 300), (8, "\x00￾￿ 😀")]
CLASH = ("rid", "h", "text_sha256", "bucket", "anchor", "_salt", "label", "n", "pos", "score")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "d.parquet")
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    df.withColumns({c: F.lit("clash") for c in CLASH}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (6, 1), (None, 1), (2, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "b C d"), (2, None), (3, ""), (None, "x Y"), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")], "item_id long, text string").withColumn("phrase", F.lit("clash"))


def run(name, docs, labels, bench):
    return {
        "suffix": lambda: suffix_dedup.remove_repeats(docs, size=20, gram=8),
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "sharding": lambda: sharding.shard_rows(docs, 8),
        "pii": lambda: pii.find_pii(docs),
        "language": lambda: language.document_languages(docs, language.train_language(docs)),
        "minhash": lambda: minhash.near_duplicates(docs, k=3, num=85),
        "exact": lambda: exact_dedup.exact_dedup(docs),
        "codec": lambda: piece_codec.encode_documents(docs, MODEL),
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench),
    }[name]()


NAMES = ["suffix", "toxicity", "sharding", "pii", "language", "minhash", "exact", "codec", "decontaminate"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(docs, labels, bench, name):
    got = run(name, docs, labels, bench).collect()
    assert len(got) == (len(ROWS) if name != "language" else len(set(ROWS)) - 0)
    if name != "language":
        assert sum(r["doc_id"] is None for r in got) == 2


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, bench, name):
    assert run(name, docs.filter("false"), labels.filter("false"), bench.filter("false")).collect() == []


def test_values(docs, labels, bench):
    got = exact_dedup.exact_dedup(docs).collect()
    same = [r for r in got if r["doc_id"] in (1, 6)]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(6, 3)} and sum(r["kept"] for r in got) == len({t or "" for _, t in ROWS})
    for r in got:
        assert r["text_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in ROWS if i == r["doc_id"]}
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k=3, num=85).collect()}
    assert got[6]["component_id"] == 1 and not got[6]["kept"] and got[3]["n_shingles"] == 0 and got[3]["kept"] and got[5]["component_id"] == 5
    got = [r for r in decontaminate.decontaminate(docs, bench).collect()]
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[6]["n_hit"] == 3 and by[2]["n_words"] == 0 and by[4]["contaminated"] and by[4]["n_hit"] == by[4]["n_words"]
    assert by[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["lossless"] for r in piece_codec.encode_documents(docs, MODEL).collect())
    back = piece_codec.decode_documents(piece_codec.encode_documents(docs, MODEL).filter("doc_id is not null"), MODEL)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((i, t or "") for i, t in ROWS if i is not None)
    for r in sharding.shard_rows(docs, 8).collect():
        texts = [t or "" for i, t in ROWS if i == r["doc_id"]]
        assert r["size"] in {len(t.encode()) + 1 for t in texts} and r["text_crc32"] in {zlib.crc32(t.encode()) for t in texts}


def test_conversations(spark):
    rows = [
        (1, 0, "user", "First line here.\n\nSecond paragraph of mine."), (1, 1, "assistant", "On Monday X wrote:\n> Second   paragraph of MINE.\nI agree."),
        (1, 2, "user", "Unrelated."), (1, 3, "assistant", ">> second paragraph of mine.\n> I agree.\nMe too."), (1, 4, "user", "> never said\nHm."),
        (2, 0, None, None), (2, 1, "user", ""), (None, None, "user", "x"), (None, None, "user", "x"), (3, 0, "user", "> " * 500 + "deep"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "m", "at", "level", "path")})
    got = quotation.link_quotations(df).collect()
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [one[t]["reply_to"] for t in range(5)] == [None, 0, None, 1, None]
    assert [one[t]["position"] for t in range(5)] == [0, 1, 3, 2, 4]
    assert one[1]["clean_text"] == "I agree." and one[3]["clean_text"] == "Me too." and one[3]["quote_depth"] == 2 and one[4]["n_linked"] == 0
    assert len(got) == len(rows) and sorted(r["position"] for r in got if r["conv_id"] is None) == [0, 1]
    assert next(r for r in got if r["conv_id"] == 3)["quote_depth"] == 500
    assert quotation.link_quotations(df.filter("false")).collect() == []


def test_partial_quotations(spark):
    lines = "First line of it.\nSecond line, a bit longer.\nThird.\nFourth one."
    paragraphs = "One paragraph that is wrapped\nover two lines.\n\nAnother paragraph here.\n\nThe third of them stands alone."
    quotes = [
        (lines, "> First line of it.\n> Second line, a bit longer.\nyes"),
        (lines, "> Third.\n> Fourth one.\nyes"),  # fewer words than a gram
        (lines, "> second line, a bit longer.\n> Third.\nyes"),
        ("A\nB\nC", "> A\n> B\nyes"),
        (paragraphs, "> One paragraph that is wrapped\n> over two lines.\n>\n> Another paragraph here.\nyes"),
        (paragraphs, "> One paragraph\n> that is wrapped over two\n> lines. Another paragraph here.\nyes"),
        (paragraphs, "> paragraph that is wrapped over\n> two lines. Another\nyes"),  # cut inside lines
        (lines, "> Second line, a bit longer.\nno\n> Third.\nyes"),
    ]
    never = [(lines, "> First line of it.\n> Third.\nHm."), (lines, "> line\nHm."), (lines, "> Fourth one.\n> First line of it.\nHm."), ("A\nB\nC", "> A\n> C\nHm.")]
    rows = [(c, t, "user", text) for c, pair in enumerate(quotes + never) for t, text in enumerate(pair)]
    # whole lines go before an earlier run inside a line
    rows += [(99, 0, "user", "He said that we meet at noon today."), (99, 1, "user", "we meet at noon today."), (99, 2, "user", "> We meet at noon today.\nok"), (99, 3, "user", "> that we meet at noon\nok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotation.link_quotations(df).collect()}
    assert [got[c, 1]["reply_to"] for c in range(len(quotes) + len(never))] == [0] * len(quotes) + [None] * len(never)
    assert all(r["n_linked"] == (r["n_quotes"] if r["reply_to"] is not None else 0) for r in got.values())
    assert got[99, 2]["reply_to"] == 1 and got[99, 3]["reply_to"] == 0


def test_values_of_the_others(spark, docs, labels):
    """Suffixes, toxicity, personal data and language on the same rows: what each comes out as."""
    texts = {i: t or "" for i, t in ROWS if i is not None}
    got = suffix_dedup.remove_repeats(docs, size=20, gram=8).collect()
    for r in got:
        raw = r["kept_bytes"]
        assert r["n_bytes"] - r["n_removed"] == len(raw) and r["kept_sha256"] == hashlib.sha256(raw).hexdigest()
        if r["doc_id"] is not None:
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["n_spans"] == by[3]["n_spans"] == by[1]["n_removed"] == 0  # "a b c d e" is shorter than a string
    assert by[4]["n_removed"] == by[4]["n_bytes"] and by[7]["n_removed"] == by[7]["n_bytes"] and by[8]["n_removed"] == 0
    got = toxicity.toxicity(docs, labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is not None} == {True, False} and not any(r["held_out"] for r in got if r["doc_id"] is None)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    empty = {round(r["score"], 12) for r in got if r["doc_id"] in (2, 3)}
    assert len(empty) == 1  # null and empty texts have the bias alone
    none = hashlib.sha256(b"").hexdigest()
    for r in pii.find_pii(docs).collect():
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) == (0, 0, 0, 0, none, "")
    got = {(r["rid"], r["h"]): r for r in language.document_languages(docs, language.train_language(docs)).collect()}
    accepted = {i for (i, _), r in got.items() if r["accepted"]}
    assert not accepted & {2, 3} and {r["lang"] for r in got.values()} == {"en"}


def test_pages(spark, docs):
    """Null and empty pages and addresses, repeated rows, clashing names."""
    model = language.train_language(spark.createDataFrame([("the and of to in that it is was for on are", "en"), ("le la les des une est dans pour que qui", "fr")] * 20, "text string, lang string"))
    page = "<html lang='fr-CA'><body>the and of that is for the</body></html>"
    rows = [(1, "http://a.example.fr/x", "<p>les des une est dans pour</p>"), (2, None, None), (3, "", ""), (4, "no address", page), (5, "https://u:p@B.Example.UK:8080/?q", "the and of that is"), (5, "https://u:p@B.Example.UK:8080/?q", "the and of that is"), (None, "http://a.example.fr/", "<p>la les des</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("h", "e", "rid", "host", "suffix", "declared", "text", "lang", "log", "fit", "grams")})
    got = language.page_languages(df, model).collect()
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert len(got) == len(rows) and sum(r["page_id"] is None for r in got) == 1 and sum(r["page_id"] == 5 for r in got) == 2
    assert (by[1]["suffix"], by[1]["lang"], by[1]["declared"]) == ("fr", "fr", None) and (by[5]["suffix"], by[5]["lang"]) == ("uk", "en")
    assert by[4]["declared"] == "fr" and by[4]["suffix"] == "" and by[4]["text_lang"] == "en"
    for i in (2, 3):
        assert by[i]["text_lang"] is None and not by[i]["accepted"] and by[i]["suffix"] == ""
    assert language.page_languages(df.filter("false"), model).collect() == []


def test_proximity_edges(spark, docs, bench):
    got = {(r["doc_id"], r["start"], r["phrase"]) for r in decontaminate.proximity_matches(docs, bench, slop=2).collect()}
    assert {(1, 1, "b c d"), (6, 1, "b c d"), (None, 0, "x y")} <= got and not any(d in (2, 3) for d, _, _ in got)
    assert decontaminate.proximity_matches(docs.filter("false"), bench).collect() == [] and decontaminate.proximity_matches(docs, bench.filter("false")).collect() == []
    near = {r["doc_id"]: r["n_near"] for r in decontaminate.decontaminate(docs, bench).collect() if r["doc_id"] is not None}
    assert near[6] == 1 and near[2] == near[3] == 0 and near[4] >= 1


def test_windows_all_over_a_long_text(spark, tmp_path):
    """A window at every fifth of 60,000 words: the cost follows the candidates, not their number times the text's words."""
    base = "lorem ipsum dolor sit amet ".split()
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, " ".join(base * 12000)), (2, "x " + " ".join([*base[:2], "y", *base[2:], *base]))], "doc_id long, text string").write.parquet(path)
    items = spark.createDataFrame([(1, " ".join(base * 2))], "item_id long, text string")
    begun = time.monotonic()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["n_near"]) for r in decontaminate.decontaminate(spark.read.parquet(path), items).collect()}
    near = sorted((r["doc_id"], r["start"]) for r in decontaminate.proximity_matches(spark.read.parquet(path), items, slop=2).collect())
    assert time.monotonic() - begun < 90
    assert got == {1: (60000, 60000, 1, 1), 2: (12, 0, 0, 1)}
    assert near == [(1, i) for i in range(0, 60000 - 9, 5)] + [(2, 1)]


def test_frequent_words_beyond_the_broadcast(spark, docs, bench):
    """The same answer whether a table is broadcast or its rows are dealt out."""
    table = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("z", 4)], "term string, v int")
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "rid long, term string")
    same = [sorted(map(tuple, decontaminate.beside(rows, table, limit).select("rid", "term", "v").collect())) for limit in (100, 1)]
    assert same[0] == same[1] and len(same[0]) == 20 + 2 * 20
