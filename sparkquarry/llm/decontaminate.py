"""Benchmark decontamination over a distributed positional inverted index.

DataFrame functions only.  A window is ``window`` consecutive words of an item
(a shorter item is one window).  The corpus frequency of every benchmark word
ranks the words of each window; postings (term, document, position) are stored
for the two rarest words of the windows.  The rarest word's list, shifted by
its offset, gives candidate starts, the second list intersects them, and the
words between are compared in the document itself.  Proximity matches come from the
same index: all words of a window, in order, with up to ``slop`` other words
between them.

Scale.  The corpus is read three times: to count, to build the index, and to
compare.  What is broadcast is the benchmark's own vocabulary and windows, and
only below ``BROADCAST_ROWS`` rows; beyond it they are joined by shuffle.  A
window's cost is the frequency of its rarest word, so frequent words cost
nothing unless a window has no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, id_out, keyed, spread_join, written

#: Fixed by the contract: a word is letters, digits and everything beyond ASCII; this is what lies between words, in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z alone to lower case; the quick path is for texts without other letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; ``df`` must be a written table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def beside(rows: DataFrame, table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, a written one, by ``term``: broadcast up to ``limit`` rows, else with the rows of a frequent word dealt to several tasks."""
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), "term")
    return spread_join(rows, "term", table, F.col("rid"))


def windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """phrase, terms, item_ids of each distinct window; a null id counts as the text "null"."""
    items = benchmark.select(
        F.coalesce(col(benchmark, id_col).cast("string"), F.lit("null")).alias("item_id"),
        words(F.coalesce(col(benchmark, text_col).cast("string"), F.lit(""))).alias("w"),
    ).filter(F.size("w") > 0)
    first = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.select("item_id", F.explode(F.transform(first, lambda i: F.slice("w", i + 1, window))).alias("terms"))
    return cut.groupBy(F.array_join("terms", " ").alias("phrase")).agg(F.first("terms").alias("terms"), F.collect_set("item_id").alias("item_ids"))


def token_rows(docs: DataFrame) -> DataFrame:
    """rid, h, pos, term of every word of ``docs`` (rid, h, text)."""
    return docs.select("rid", "h", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def index_terms(docs: DataFrame, win: DataFrame) -> DataFrame:
    """wid, phrase, n, k0, t0, k1, t1: windows whose words all occur, with their two rarest words."""
    vocabulary = written(win.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = beside(token_rows(docs).select("term", "rid"), vocabulary).groupBy("term").agg(F.count("*").alias("cf"))
    terms = win.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("k", "term"))
    ranked = terms.join(counts, "term", "left").groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("cf", "k", "term"))).alias("r"))
    ranked = ranked.filter(~F.exists("r", lambda x: x["cf"].isNull()))
    a, b = F.col("r")[0], F.when(F.size("r") > 1, F.get("r", F.lit(1))).otherwise(F.col("r")[0])
    return ranked.select(F.xxhash64("phrase").alias("wid"), "phrase", "n", a["k"].alias("k0"), a["term"].alias("t0"), b["k"].alias("k1"), b["term"].alias("t1"))


def postings(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The index: (term, rid, h, pos) for the words by which windows are looked up."""
    terms = written(ranked.select(F.explode(F.array("t0", "t1")).alias("term")).distinct(), "terms")
    return beside(token_rows(docs), terms).select("term", "rid", "h", "pos")


def candidates(index: DataFrame, ranked: DataFrame, slop: int = 0) -> DataFrame:
    """rid, h, start, wid, phrase, n where the two rarest words lie at their offsets, or in order with ``slop`` words more between them."""
    found = beside(index, ranked.withColumnRenamed("t0", "term")).select("rid", "h", (F.col("pos") - F.col("k0")).alias("start"), "wid", "phrase", "n", "k0", "k1", "t1")
    if not slop:
        found = found.filter("start >= 0")
    at = F.col("start") + F.col("k1")
    near = F.when(F.col("k1") >= F.col("k0"), F.sequence(at, at + slop)).otherwise(F.sequence(at - slop, at)) if slop else F.array(at)
    wanted = found.withColumn("pos", F.explode(near)).withColumnRenamed("t1", "term")
    kept = wanted.join(index, ["rid", "h", "pos", "term"], "left_semi").select("rid", "h", "start", "wid", "phrase", "n")
    return kept.distinct() if slop else kept


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).select("rid", F.xxhash64("text").alias("h"), "text")


def _in_order(w: Column, s: Column, terms: Column, slop: int) -> Column:
    """Whether all ``terms`` stand in order among the words of ``w`` from ``s`` (0-based), the first right there, with ``slop`` others at most."""
    end = s + F.size(terms) + slop
    # words are read by place: a slice would copy the whole text's words each time
    step = lambda p, t: F.when(p < end, F.get(F.filter(F.sequence(p, F.least(p + slop, end - 1)), lambda i: F.get(w, i) == t), F.lit(0)) + 1)
    return (F.get(w, s) == terms[0]) & (F.coalesce(F.aggregate(terms, s, step), F.lit(-1)) > 0)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 2, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, start, phrase: where all words of a window stand in order, the first as word ``start``, with ``slop`` other words between them at most.

    Exact occurrences are among them.  Nulls, empty texts and empty tables
    are treated as in :func:`decontaminate`; repeated rows give one result.
    """
    texts = keyed_texts(docs, id_col, text_col)
    ranked = written(index_terms(texts, windows(benchmark, window, item_col, item_text)), "ranked")
    found = _starts(candidates(written(postings(texts, ranked), "postings"), ranked, slop))
    both = texts.hint("shuffle_hash").join(found.hint("shuffle_hash"), ["rid", "h"]).select("rid", words(F.col("text")).alias("w"), "found")
    return both.select("rid", F.explode(_near("w", slop)).alias("x")).select(id_out().alias("doc_id"), "x.start", "x.phrase").distinct()


def _starts(found: DataFrame) -> DataFrame:
    """rid, h, found: the distinct candidates (start, phrase) of each document."""
    return found.groupBy("rid", "h").agg(F.collect_set(F.struct("start", "phrase")).alias("found"))


def _near(w: str, slop: int) -> Column:
    """The places (start, phrase) of candidates ``found`` at which a window's words stand in order, some more than once; a document's words are looked at where they are, for all its candidates."""
    # up to slop other words may stand before the rarest word
    starts = lambda x: F.sequence(F.greatest(x["start"] - slop, F.lit(0)), F.greatest(x["start"], F.lit(0)))
    right = lambda x: F.filter(starts(x), lambda s: _in_order(F.col(w), s, F.split(x["phrase"], " "), slop))
    return F.flatten(F.transform("found", lambda x: F.transform(right(x), lambda s: F.struct(s.alias("start"), x["phrase"].alias("phrase")))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near; one row per input row.

    ``n_near`` counts the distinct windows whose words all stand in the text
    in order, with ``slop`` other words between them at most; exact occurrences
    are among them, and it decides nothing.  Null and empty texts have no words and hit nothing; items without words
    have no window.  Repeated rows each get their result; a null id comes out
    null.  Empty tables give no rows, or no hits.
    """
    found = hit_documents(docs, benchmark, window, id_col, text_col, item_col, item_text, slop)
    return found.select(id_out().alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def hit_documents(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """rid, h and what :func:`decontaminate` returns; ``n_near`` only if there is a ``slop``."""
    texts = keyed_texts(docs, id_col, text_col)
    win = written(windows(benchmark, window, item_col, item_text), "windows")
    ranked = written(index_terms(texts, win), "ranked")
    index = written(postings(texts, ranked), "postings")
    found = candidates(index, ranked)
    starts = found.groupBy("rid", "h").agg(F.collect_set(F.struct("start", "wid", "phrase", "n")).alias("exact"))
    if slop is not None:
        starts = starts.join(_starts(candidates(index, ranked, slop)), ["rid", "h"], "full")
    starts = written(starts, "candidates")
    near = [] if slop is None else [F.size(F.array_distinct(F.transform(F.coalesce(_near("w", slop), F.array()), lambda x: x["phrase"]))).cast("long").alias("n_near")]
    compared = texts.hint("shuffle_hash").join(starts.hint("shuffle_hash"), ["rid", "h"], "left").select("rid", "h", words(F.col("text")).alias("w"), *starts.columns[2:])
    there = lambda x: F.transform(F.sequence(x["start"], x["start"] + x["n"] - 1), lambda i: F.get("w", i))
    true = F.filter(F.coalesce("exact", F.array()), lambda x: F.array_join(there(x), " ") == x["phrase"])
    hits = compared.select("rid", "h", F.size("w").cast("long").alias("n_words"), true.alias("hits"), *near)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    hits = written(hits.select("rid", "h", "n_words", F.when(F.size("hits") == 0, 0).otherwise(covered).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["wid"])).alias("wids"), *(["n_near"] if near else [])), "hits")
    items = win.select(F.xxhash64("phrase").alias("wid"), F.explode("item_ids").alias("item_id"))
    per_doc = hits.select("rid", "h", F.explode("wids").alias("wid")).join(items, "wid").groupBy("rid", "h").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = hits.join(per_doc, ["rid", "h"], "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.select(
        "rid", "h", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *(["n_near"] if near else []),
    )
