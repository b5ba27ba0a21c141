"""Chunk scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from .registry import query

_W = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"
_S = "list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"
_BOILER = "'" + "', '".join(T.BOILERPLATE) + "'"
CHUNKS = f"""
SELECT doc_id, text, source, lang, w, len(w) AS nw,
  len(list_filter(w, lambda x: x IN ({_BOILER}))) AS boiler,
  CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [] END AS g,
  len(list_filter(s, lambda x: length(x) > 10)) AS long_s, len(list_filter(s, lambda x: length(x) > 0)) AS n_s,
  length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS ascii
FROM (SELECT doc_id, text, source, lang, {_W} AS w, {_S} AS s FROM documents)"""
SCORES = f"""
SELECT doc_id,
  CASE WHEN nw < 10 THEN 0.0::DOUBLE ELSE greatest(0, least(100, 100 * (1 - boiler::DOUBLE / nw - (len(g) - len(list_distinct(g)))::DOUBLE / len(g)))) END AS density_score,
  CASE WHEN long_s = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, 100 - CASE WHEN regexp_matches(text, '^\\p{{Ll}}') THEN 25 ELSE 0 END
    - CASE WHEN right(text, 1) IN ('.', '!', '?') THEN 0 ELSE 25 END + CASE WHEN long_s >= 2 THEN 10 ELSE 0 END) END AS completeness_score,
  CASE WHEN n_s = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN nw::DOUBLE / n_s BETWEEN 15 AND 25 THEN 100.0::DOUBLE WHEN nw::DOUBLE / n_s < 15 THEN 80 ELSE greatest(0, 100 - (nw::DOUBLE / n_s - 25) * 2) END
    + CASE WHEN ascii > 0.95 THEN 100.0::DOUBLE ELSE ascii * 100 END) / 2 END AS readability_score,
  (CASE WHEN coalesce(source, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(lang, '') <> '' THEN 1 ELSE 0 END)::DOUBLE / 3 * 80 AS metadata_score,
  CASE WHEN length(text) BETWEEN 200 AND 800 THEN 100.0::DOUBLE WHEN length(text) < 200 THEN length(text)::DOUBLE / 200 * 100 ELSE greatest(0, 100 - (length(text) - 800)::DOUBLE / 20) END AS length_score
FROM ({CHUNKS})"""
TOTALS = f"""
SELECT *, density_score * 0.30 + completeness_score * 0.25 + readability_score * 0.20 + metadata_score * 0.15 + length_score * 0.10 AS total FROM ({SCORES})"""
# a total within 1e-9 of the bound would be passed by either engine's order of additions
PASSED = f"SELECT *, round(total, 9) >= 70 AS passed FROM ({TOTALS})"


def chunks(t) -> DataFrame:
    """Documents as chunks: source and language are the metadata that there is."""
    return t.documents.select("doc_id", "text", F.create_map(F.lit("source"), F.col("source"), F.lit("section"), F.col("lang")).alias("metadata"))


def scored(t) -> DataFrame:
    return C.score_chunks(chunks(t)).withColumn("passed", F.round("total", 9) >= 70).drop("text", "metadata")


@query(f"SELECT doc_id, density_score FROM ({SCORES})", ("density_score",))
def chunk_density(t):
    return t.documents.select("doc_id", T.density_score(F.col("text")).alias("density_score"))


@query(f"SELECT doc_id, completeness_score FROM ({SCORES})", ("completeness_score",))
def chunk_completeness(t):
    return t.documents.select("doc_id", T.completeness_score(F.col("text")).alias("completeness_score"))


@query(f"SELECT doc_id, readability_score FROM ({SCORES})", ("readability_score",))
def chunk_readability(t):
    return t.documents.select("doc_id", T.readability_score(F.col("text")).alias("readability_score"))


@query(f"SELECT doc_id, metadata_score FROM ({SCORES})", ("metadata_score",))
def chunk_metadata(t):
    none = F.lit(None).cast("string")
    return t.documents.select("doc_id", T.metadata_score([F.col("source"), none, F.col("lang")], [none, none, none]).alias("metadata_score"))


@query(f"SELECT doc_id, length_score FROM ({SCORES})", ("length_score",))
def chunk_length(t):
    return t.documents.select("doc_id", T.length_score(F.col("text")).alias("length_score"))


@query(PASSED, ("density_score", "completeness_score", "readability_score", "metadata_score", "length_score", "total"))
def chunk_quality_score(t):
    return scored(t)


@query(
    f"SELECT count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed, avg(passed::INT) * 100 AS pass_rate, avg(total) AS mean_score, avg(passed::INT) * 100 < 60 AS low_pass_alert FROM ({PASSED})",
    ("pass_rate", "mean_score"),
)
def quality_gate_summary(t):
    return C.gate_summary(scored(t))


@query(
    "SELECT doc_id, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {k}_score < 60 THEN '{r}' END" for k, r in C.REASONS.items())
    + f") AS reasons FROM ({SCORES})"
)
def failure_reasons(t):
    return scored(t).select("doc_id", F.array_join(C.failure_reasons(), "; ").alias("reasons"))


@query(f"SELECT quantile_cont(total, 0.15) AS threshold, median(total) AS median_score, stddev_pop(total) AS deviation FROM ({TOTALS})", ("threshold", "median_score", "deviation"))
def score_percentile_threshold(t):
    return scored(t).agg(F.percentile("total", 0.15).alias("threshold"), F.median("total").alias("median_score"), F.stddev_pop("total").alias("deviation"))


@query("SELECT source, lang, count(*) AS n, avg(len(string_split(text, chr(10)))) AS mean_lines, max(length(text)) AS longest FROM documents GROUP BY ALL", ("mean_lines",))
def chunk_set_statistics(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg(F.size(F.split("text", "\n"))).alias("mean_lines"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents")
def chunk_split(t):
    """Lines as chunks, numbered from 0 inside their document."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"SELECT doc_id, w[1:5] AS head, left(text, 100) AS preview FROM ({CHUNKS})")
def chunk_preview(t):
    return t.documents.select("doc_id", F.slice(T.words(F.col("text")), 1, 5).alias("head"), F.substring("text", 1, 100).alias("preview"))
