"""Exposition, ratios of series, drift verdicts, alert routing, plan reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least statistic and greatest p of a drift; points, factor and points that recommendations start from.
DRIFT_STATISTIC, DRIFT_P = 0.15, 0.05
QUALITY_POINTS, LENGTH_FACTOR, DENSITY_POINTS = 10.0, 1.5, -15.0
#: Seconds that routing waits for a first notice, between notices of a changed group, and before a repeat.
GROUP_WAIT, GROUP_INTERVAL, REPEAT_INTERVAL = 30, 300, 4 * 3600
#: Fixed value: milliseconds from which an execution is slow.
SLOW_MS = 1000.0


def label_text(labels: dict[str, Column]) -> Column:
    """Labels as ``{a="x",b="y"}``, names sorted; backslashes, quotes and line ends escaped."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    parts = [F.concat(F.lit(f'{n}="'), quoted(c), F.lit('"')) for n, c in sorted(labels.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def exposition(samples: DataFrame, metric: str, labels: Sequence[str], value: str = "value") -> DataFrame:
    """line: one exposition line for each sample."""
    return samples.select(F.concat(F.lit(metric), label_text({c: F.col(c) for c in labels}), F.lit(" "), F.col(value).cast("string")).alias("line"))


def histogram_exposition(samples: DataFrame, metric: str, help_text: str, labels: Sequence[str], bounds: Sequence[float], value: str = "value") -> DataFrame:
    """position, line: a histogram's lines as a scraper reads them, ordered by ``position``.

    HELP and TYPE come first, then for each series (in the order of its labels)
    a line for every bound with the samples at or below it, one for +Inf, the
    sum to six places and the count.  Null values are no samples.
    """
    known = samples.filter(F.col(value).isNotNull())
    at = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    # decimals add up to the same whatever their order
    series = known.groupBy(*labels).agg(*at, F.sum(F.col(value).cast("decimal(38,6)")).cast("decimal(38,6)").alias("_sum"), F.count("*").alias("_n"))
    own = {c: F.col(c) for c in labels}

    def line(suffix: str, number: Column, le: str | None = None) -> Column:
        said = label_text(own if le is None else own | {"le": F.lit(le)})
        return F.concat(F.lit(metric + suffix), said, F.lit(" "), number.cast("string"))

    buckets = [line("_bucket", F.col(f"_b{i}"), f"{b:g}") for i, b in enumerate(bounds)]
    lines = series.select(*labels, F.posexplode(F.array(*buckets, line("_bucket", F.col("_n"), "+Inf"), line("_sum", F.col("_sum")), line("_count", F.col("_n")))).alias("_k", "line"))
    # a row for each series and bound: the size of a scrape
    body = lines.withColumn("position", F.row_number().over(Window.orderBy(*labels, "_k")) + 2).select("position", "line")
    head = samples.sparkSession.createDataFrame([(1, f"# HELP {metric} {help_text}"), (2, f"# TYPE {metric} histogram")], "position int, line string")
    return head.unionByName(body)


def buffered_means(points: DataFrame, keys: Sequence[str], time: str = "ts", value: str = "value", seconds: int = 60) -> DataFrame:
    """What a buffer that is emptied every ``seconds`` sends: the mean of each full or partial interval."""
    start = F.window(F.col(time).cast("timestamp"), f"{seconds} seconds")["start"].cast("timestamp_ntz")
    return points.groupBy(*keys, start.alias("flushed")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def divided(over: DataFrame, under: DataFrame, labels: Sequence[str], value: str = "value") -> DataFrame:
    """Division of two series that agree in ``labels``; series without a partner, and divisors of zero, give nothing."""
    b = under.select(*labels, F.col(value).alias("_under"))
    return over.join(b, list(labels)).filter("_under <> 0").select(*labels, (F.col(value) / F.col("_under")).alias("ratio"))


def drift_verdicts(tests: DataFrame, means: DataFrame) -> DataFrame:
    """has_drift, drift_score, p_value, affected_metrics, recommendations of each ``batch``.

    ``tests``: batch, metric, statistic, p.  ``means``: batch, metric,
    baseline, current.  Metrics are quality_score, chunk_length and
    information_density.
    """
    drifted = (F.col("statistic") > DRIFT_STATISTIC) & (F.col("p") < DRIFT_P)
    change = F.col("current") - F.col("baseline")
    m = F.col("metric")
    said = (
        F.when((m == "quality_score") & (change < -QUALITY_POINTS), "quality_degraded")
        .when((m == "quality_score") & (change > QUALITY_POINTS), "quality_improved")
        .when((m == "chunk_length") & (F.col("current") > F.col("baseline") * LENGTH_FACTOR), "chunks_longer")
        .when((m == "information_density") & (change < DENSITY_POINTS), "density_dropped")
    )
    rows = tests.join(means, ["batch", "metric"]).withColumn("drifted", drifted)
    return rows.groupBy("batch").agg(
        F.bool_or("drifted").alias("has_drift"), F.round(F.max("statistic"), 3).alias("drift_score"), F.round(F.min("p"), 4).alias("p_value"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted"), m))), ",").alias("affected_metrics"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted"), said))), ",").alias("recommendations"),
    )


def rolling_samples(rows: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Each day's rows as sample 1 beside those of the ``days`` before as sample 0: a row is in ``days`` + 1 comparisons at most."""
    last = rows.agg(F.max(day).alias("_last"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(days)))
    return rows.select("*", ahead.alias("_ahead")).join(F.broadcast(last)).withColumn("batch", F.date_add(day, F.col("_ahead"))).filter("batch <= _last").withColumn("sample", (F.col("_ahead") == 0).cast("int")).drop("_ahead", "_last")


def routed(alerts: DataFrame, group: Sequence[str], time: str = "ts", wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL) -> DataFrame:
    """Notices: a group's first is sent ``wait`` seconds after its first alert, later alerts join the notice at the next multiple of ``interval`` from there.

    A notice lists what came since the one before, so alerts of one slot make
    one notice.  Grouping is by slots from the group's first alert of the day,
    which needs no fold over the alerts.
    """
    # alerts of one second are one row from here on
    seconds = alerts.groupBy(*group, F.to_date(time).alias("_day"), F.unix_seconds(F.col(time).cast("timestamp")).alias("_at")).agg(F.count("*").alias("_n"))
    rows = seconds.join(seconds.groupBy(*group, "_day").agg(F.min("_at").alias("_first")), [*group, "_day"])
    late = F.col("_at") - F.col("_first")
    slot = F.when(late <= wait, F.lit(0)).otherwise(F.ceil((late - wait) / interval)).cast("long")
    rows = rows.withColumn("slot", slot).withColumn("sent", F.timestamp_seconds(F.col("_first") + wait + slot * interval).cast("timestamp_ntz"))
    return rows.groupBy(*group, "slot", "sent").agg(F.sum("_n").alias("n_alerts"))


def repeats(firing: DataFrame, group: Sequence[str], start: str = "start_at", end: str = "end_at", every: int = REPEAT_INTERVAL) -> DataFrame:
    """A notice when a group starts firing and again every ``every`` seconds as long as it fires."""
    s, e = F.unix_seconds(F.col(start).cast("timestamp")), F.unix_seconds(F.col(end).cast("timestamp"))
    return firing.select(*group, F.explode(F.sequence(s, F.greatest(s, e), F.lit(every).cast("long"))).alias("_at")).select(*group, F.timestamp_seconds("_at").cast("timestamp_ntz").alias("sent"))


def plan_issues(plan: Column) -> Column:
    """Array of what stands out in the text of a query plan: sequential_scan, large_hash_join, slow_execution."""
    ms = F.regexp_extract(plan, r"actual time=[\d.]+\.\.([\d.]+)", 1)
    found = F.array(
        F.when(plan.contains("Seq Scan"), "sequential_scan"),
        F.when(plan.contains("Hash Join") & F.lower(plan).contains("large"), "large_hash_join"),
        F.when(F.coalesce(F.nullif(ms, F.lit("")).try_cast("double"), F.lit(0.0)) > SLOW_MS, "slow_execution"),
    )
    return F.array_compact(found)
