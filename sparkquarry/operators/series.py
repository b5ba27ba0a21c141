"""Time series: counters, trailing windows, histograms, sustained conditions.

A series is identified by its label columns; every window is partitioned by
them, so series are spread over the cluster.  Ties in time are broken by the
given id column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def increases(df: DataFrame, labels: Sequence[str], ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Adds ``delta``: growth since the sample before; after a reset the value itself, 0 for a series' first sample."""
    before = F.lag(value).over(Window.partitionBy(*labels).orderBy(ts, tie))
    return df.withColumn("delta", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def trailing(labels: Sequence[str], seconds: int, ts: str = "ts") -> Window:
    return Window.partitionBy(*labels).orderBy(epoch(F.col(ts))).rangeBetween(-seconds, 0)


def bucket_counts(df: DataFrame, labels: Sequence[str], bounds: Sequence[float], value: str = "value") -> DataFrame:
    """Cumulative counts for each bound and for infinity: labels, le, n. One pass: a value adds to its first bucket, buckets are summed afterwards."""
    first = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        first = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(first)
    own = df.filter(F.col(value).isNotNull()).groupBy(*labels, first.alias("le")).agg(F.count("*").alias("n"))
    grid = own.select(*labels).distinct().withColumn("le", F.explode(F.array(*[F.lit(float(b)) for b in sorted(bounds)], F.lit(float("inf")))))
    full = grid.join(own, [*labels, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("n", F.sum("n").over(Window.partitionBy(*labels).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)))


def bucket_quantile(buckets: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """Quantile of cumulative buckets with linear interpolation: labels, quantile.

    The lowest bucket begins at 0; in the infinite one the answer is the
    greatest finite bound; no samples give null.
    """
    w = Window.partitionBy(*labels).orderBy("le")
    b = buckets.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    b = b.withColumn("rank", q * F.max("n").over(Window.partitionBy(*labels)))
    hit = b.filter((F.col("n") >= F.col("rank")) & (F.col("n") > 0)).groupBy(*labels).agg(F.min(F.struct("le", "lo", "n", "below", "rank")).alias("h"))
    h = F.col("h")
    value = F.when(h["le"] == float("inf"), h["lo"]).otherwise(h["lo"] + (h["le"] - h["lo"]) * F.try_divide(h["rank"] - h["below"], (h["n"] - h["below"]).cast("double")))
    return hit.select(*labels, value.alias("quantile"))


def sustained(df: DataFrame, labels: Sequence[str], condition: Column, seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``firing``: the condition holds, and has held at every sample for ``seconds``. A missing sample resets nothing."""
    w = Window.partitionBy(*labels).orderBy(ts, tie)
    df = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    df = df.withColumn("_new", (F.col("_on") != F.coalesce(F.lag("_on").over(w), ~F.col("_on"))).cast("int"))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(epoch(F.col(ts))).over(Window.partitionBy(*labels, "_island"))
    return df.withColumn("firing", F.col("_on") & (epoch(F.col(ts)) - since >= seconds)).drop("_on", "_new", "_island")


def sessions(df: DataFrame, labels: Sequence[str], seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``session``, from 1: a gap of ``seconds`` or more begins a new one."""
    w = Window.partitionBy(*labels).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    df = df.withColumn("_new", F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0))
    return df.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def nearest_rank(df: DataFrame, labels: Sequence[str], q: float, value: str = "value") -> DataFrame:
    """The value at index int(n q) of the sorted values: labels, n, nearest_rank. Values are counted first, so a group is as large as its distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*labels).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*labels)))
    return counts.filter(F.col("upto") > F.floor(F.col("n") * q)).groupBy(*labels).agg(F.max("n").alias("n"), F.min(value).alias("nearest_rank"))


def coverage_gaps(df: DataFrame, labels: Sequence[str], start: str, end: str) -> DataFrame:
    """Gaps between intervals [start, end) that nothing covers: labels, gap_start, gap_end."""
    w = Window.partitionBy(*labels).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_reach", reach).filter(F.col(start) > F.col("_reach")).select(*labels, F.col("_reach").alias("gap_start"), F.col(start).alias("gap_end"))
