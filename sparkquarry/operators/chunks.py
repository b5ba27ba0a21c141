"""Chunk quality: five scores, their weighted total, reasons, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WEIGHTS = {"density": 0.30, "completeness": 0.25, "readability": 0.20, "metadata": 0.15, "length": 0.10}
REASONS = {
    "density": "High boilerplate or repetition detected",
    "completeness": "Incomplete sentences or fragments",
    "readability": "Poor readability or encoding issues",
    "metadata": "Missing required metadata fields",
    "length": "Chunk length outside optimal range",
}


def score_chunks(chunks: DataFrame, text: str = "text", metadata: str = "metadata", min_score: float = 70.0) -> DataFrame:
    """Adds the five scores, ``total`` and ``passed`` (of the unrounded total) to chunks with a text and a metadata map."""
    t, m = F.coalesce(F.col(text), F.lit("")), F.col(metadata)
    scores = {
        "density": T.density_score(t), "completeness": T.completeness_score(t), "readability": T.readability_score(t),
        "metadata": T.metadata_score([m[k] for k in ("source", "date", "section")], [m[k] for k in ("author", "version", "tags")]), "length": T.length_score(t),
    }
    scored = chunks.withColumns({f"{k}_score": c for k, c in scores.items()})
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("total", total).withColumn("passed", F.col("total") >= min_score)


def failure_reasons(below: float = 60.0) -> Column:
    """Reasons, in the order of the scores, as an array."""
    return F.array_compact(F.array(*[F.when(F.col(f"{k}_score") < below, r) for k, r in REASONS.items()]))


def gate_summary(scored: DataFrame, alert_below: float = 60.0) -> DataFrame:
    """One row: chunks, passed, failed, pass rate in per cent, mean total, whether the rate is alarming."""
    rate = F.avg(F.col("passed").cast("double")) * 100
    return scored.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), rate.alias("pass_rate"), F.avg("total").alias("mean_score")).withColumn("low_pass_alert", F.col("pass_rate") < alert_below)
