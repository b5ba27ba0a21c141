"""Answer-quality evaluations: totals, baselines, thresholds, samples, reviewers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed_order

#: Weights of the four metrics.
WEIGHTS = {"faithfulness": 0.40, "answer_relevancy": 0.25, "context_precision": 0.20, "context_recall": 0.15}
#: Thresholds by domain; the general ones hold for others.
THRESHOLDS = {
    "compliance": {"faithfulness": 0.90, "answer_relevancy": 0.75, "context_precision": 0.70, "context_recall": 0.80},
    "customer_support": {"faithfulness": 0.75, "answer_relevancy": 0.85, "context_precision": 0.65, "context_recall": 0.70},
    "general": {"faithfulness": 0.70, "answer_relevancy": 0.70, "context_precision": 0.70, "context_recall": 0.70},
}


def overall(scores: dict[str, Column]) -> Column:
    return sum((scores[m] * w for m, w in WEIGHTS.items()), F.lit(0.0))


def low_metrics(scores: dict[str, Column], below: float = 0.7) -> Column:
    return F.array_compact(F.array(*[F.when(scores[m] < below, m) for m in WEIGHTS]))


def against_baseline(current: DataFrame, baseline: DataFrame, drop: float = 0.05, high: float = 0.10) -> DataFrame:
    """metric, current, baseline, delta, percent_change, verdict of (metric, score) tables; no baseline counts as 0, with no percentage."""
    j = current.select("metric", F.col("score").alias("current")).join(baseline.select("metric", F.col("score").alias("baseline")), "metric", "left")
    j = j.withColumn("baseline", F.coalesce("baseline", F.lit(0.0))).withColumn("delta", F.col("current") - F.col("baseline"))
    d = F.round("delta", 9)
    verdict = F.when(d < -high, "regression_high").when(d < -drop, "regression_medium").when(d > drop, "improvement").otherwise("stable")
    return j.withColumn("percent_change", F.when(F.col("baseline") > 0, F.col("delta") / F.col("baseline") * 100).otherwise(0.0)).withColumn("verdict", verdict)


def against_thresholds(scores: DataFrame, domain: str) -> DataFrame:
    """Adds threshold, margin, passed and the severity of a miss to (metric, score)."""
    bounds = THRESHOLDS.get(domain, THRESHOLDS["general"])
    bound = F.lit(0.70)
    for m, b in bounds.items():
        bound = F.when(F.col("metric") == m, b).otherwise(bound)
    out = scores.withColumn("threshold", bound).withColumn("margin", F.col("score") - F.col("threshold")).withColumn("passed", F.round("margin", 9) >= 0)
    gap = F.round(-F.col("margin"), 9)
    return out.withColumn("severity", F.when(F.col("passed"), F.lit(None)).when(gap > 0.20, "critical").when(gap > 0.10, "high").when(gap > 0.05, "medium").otherwise("low"))


def weighted_merge(batches: DataFrame, groups: Sequence[str], score: str = "score", n: str = "n") -> DataFrame:
    return batches.groupBy(*groups).agg((F.sum(F.col(score) * F.col(n)) / F.sum(n)).alias("score"), F.sum(n).alias("n"))


def consecutive_low(runs: DataFrame, groups: Sequence[str], order: str, score: str, bound: Column, times: int = 3) -> DataFrame:
    """Adds ``fires``: this and the runs before it, ``times`` in all, are below the bound."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(-(times - 1), 0)
    low = (F.col(score) < bound).cast("int")
    return runs.withColumn("fires", (F.sum(low).over(w) == times))


def z_regressions(history: DataFrame, current: DataFrame) -> DataFrame:
    """metric, runs, current_score, baseline, z, is_regression; with fewer than three runs a drop of more than 0.05 counts. One-sided at 5 %."""
    b = history.groupBy("metric").agg(F.count("*").alias("runs"), F.avg("score").alias("baseline"), F.stddev_pop("score").alias("_sd"))
    j = b.join(current, "metric").withColumn("z", (F.col("current_score") - F.col("baseline")) / (F.col("_sd") + 1e-6))
    flag = F.when(F.col("runs") < 3, F.col("baseline") - F.col("current_score") > 0.05).otherwise(F.col("z") < -1.6448536269514722)
    return j.select("metric", "runs", "current_score", "baseline", "z", flag.alias("is_regression"))


def numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``rn`` from 1 in the given order; one task numbers all, so it is for small tables."""
    return df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: str = "42") -> DataFrame:
    """Of each stratum its share of ``total`` (rounded down), in hash order."""
    n = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    n = n.join(n.agg(F.sum("_n").alias("_all"))).withColumn("_quota", F.floor(F.lit(total) * F.col("_n") / F.col("_all")))
    w = Window.partitionBy(stratum).orderBy(hashed_order(F.col(key), F.lit(seed)), key)
    return df.join(n, stratum).withColumn("_rn", F.row_number().over(w)).filter("_rn <= _quota").drop("_n", "_all", "_quota", "_rn")


def top_per_cluster(df: DataFrame, cluster: str, score: str, key: str, each: int, total: int) -> DataFrame:
    """The ``each`` best of every cluster, then the best of the rest, ``total`` in all; adds ``pick`` (cluster or fill). Clusters first, best first.

    Only a cluster's best ``total`` can be chosen, so the last ordering sees at
    most that many for each cluster.
    """
    w = Window.partitionBy(cluster).orderBy(F.col(score).desc(), key)
    r = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= total)
    r = r.withColumn("pick", F.when(F.col("_rn") <= each, "cluster").otherwise("fill"))
    return r.orderBy("pick", F.col(score).desc(), key).limit(total).drop("_rn")


def ordinal_alpha(ratings: DataFrame, unit: str = "unit", rating: str = "rating") -> DataFrame:
    """Krippendorff's alpha for ordinal ratings: one row (units, alpha).

    Ratings of a unit are counted by value, so pairs come from value counts;
    what is left is a table of value pairs.
    """
    c = ratings.filter(F.col(rating).isNotNull()).groupBy(unit, rating).agg(F.count("*").alias("k"))
    m = c.groupBy(unit).agg(F.sum("k").alias("m")).filter("m >= 2")
    c = c.join(m, unit)
    a, b = c.alias("a"), c.alias("b")
    same = F.col(f"a.{rating}") == F.col(f"b.{rating}")
    weight = F.col("a.k") * (F.col("b.k") - F.when(same, 1).otherwise(0)) / (F.col("a.m") - 1)
    o = a.join(b, F.col(f"a.{unit}") == F.col(f"b.{unit}")).groupBy(F.col(f"a.{rating}").alias("c"), F.col(f"b.{rating}").alias("d")).agg(F.sum(weight).alias("o"))
    n = o.groupBy("c").agg(F.sum("o").alias("n"))
    upto = F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("upto", upto)
    p, q = n.alias("p"), n.alias("q")
    cells = p.join(q, F.col("p.c") < F.col("q.c")).select(F.col("p.c").alias("c"), F.col("q.c").alias("d"), F.col("p.n").alias("nc"), F.col("q.n").alias("nd"), F.pow(F.col("q.upto") - F.col("p.upto") + F.col("p.n") - (F.col("p.n") + F.col("q.n")) / 2, 2).alias("w"))
    t = cells.join(o, ["c", "d"], "left").agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("w")).alias("do"), F.sum(F.col("nc") * F.col("nd") * F.col("w")).alias("de"))
    units, total = m.agg(F.count("*").alias("units")), n.agg(F.sum("n").alias("total"))
    return t.join(units).join(total).select("units", F.when(F.col("de") > 0, 1 - (F.col("total") - 1) * F.col("do") / F.col("de")).otherwise(1.0).alias("alpha"))
