"""Anomalies against a seasonal baseline; alerts, incidents, runbooks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import epoch, sessions

#: Which alerts share a cause.
CORRELATION = {
    "database_issues": ("HighVectorDBLatency", "CacheMissRate", "QueryTimeout", "ConnectionPoolExhausted"),
    "api_rate_limits": ("OpenAIRateLimit", "HighAPILatency", "APIErrors", "CostSpike"),
    "memory_pressure": ("HighMemoryUsage", "GCPauses", "OOMKills", "SwapUsage"),
    "disk_issues": ("DiskSpaceLow", "IOWaitHigh", "LogRotationFailed"),
}
#: Runbook, the alerts it answers, whether somebody must agree; the first that applies is taken.
RUNBOOKS = (
    ("FlushRedisCache", ("RedisCacheFull", "HighMemoryUsage"), False),
    ("RestartConnectionPool", ("ConnectionPoolExhausted", "DatabaseConnectionFailed"), False),
    ("EnableAggressiveCaching", ("OpenAIRateLimit", "CostSpike"), False),
    ("ScaleWorkers", ("HighCPUUsage", "QueryQueueBackup"), True),
    ("RestartService", ("ServiceUnhealthy", "MemoryLeak"), True),
)
LEVELS = {"info": 1, "warning": 2, "critical": 3}


def correlation_group(name: Column) -> Column:
    found = F.concat(F.lit("uncorrelated_"), name)
    for group, names in CORRELATION.items():
        found = F.when(name.isin(*names), group).otherwise(found)
    return found


def level(severity: Column) -> Column:
    """Rank of a severity; unknown ones are 0."""
    found = F.lit(0)
    for name, rank in LEVELS.items():
        found = F.when(severity == name, rank).otherwise(found)
    return found


def seasonal_scores(df: DataFrame, labels: Sequence[str], hour: str, value: str, days: int = 7, least: int = 3) -> DataFrame:
    """Adds ``expected`` and ``severity`` (deviations from the mean) of hourly points against the same hour of the trailing days; too few or equal points: 0."""
    w = Window.partitionBy(*labels, F.hour(hour)).orderBy(epoch(F.col(hour))).rangeBetween(-days * 86400, -3600)
    n, m, s = F.count("*").over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    df = df.withColumns({"_n": n, "_m": m, "_s": s})
    out = df.withColumn("expected", F.when(F.col("_n") >= least, F.col("_m"))).withColumn("severity", F.when((F.col("_n") < least) | (F.col("_s") < 1e-9), 0.0).otherwise(F.abs(F.col(value) - F.col("_m")) / F.col("_s")))
    return out.drop("_n", "_m", "_s")


def threshold_actions(df: DataFrame, labels: Sequence[str], ts: str, page: float, watch: float, log: float, seconds: int, share: float) -> DataFrame:
    """Adds ``action``: page at once, page when enough of the trailing points are raised, log, or none."""
    raised = F.avg((F.col("severity") >= log).cast("double")).over(Window.partitionBy(*labels).orderBy(epoch(F.col(ts))).rangeBetween(-seconds, 0))
    df = df.withColumn("_share", raised)
    action = F.when(F.col("severity") >= page, "page").when((F.col("severity") >= watch) & (F.col("_share") > share), "page_sustained").when(F.col("severity") >= log, "log").otherwise("none")
    return df.withColumn("action", action).drop("_share")


def in_context(df: DataFrame, ts: str, traffic: Column) -> DataFrame:
    """Per point in time: critical when traffic and anything else are anomalous (column ``a``), info when any one is."""
    both = F.bool_or(F.col("a") & traffic) & F.bool_or(F.col("a") & ~traffic)
    return df.groupBy(ts).agg(F.when(both, "critical").when(F.bool_or("a"), "info").otherwise("none").alias("severity"))


def merged_windows(windows: DataFrame) -> DataFrame:
    """day, start_at, end_at: ``windows`` (start_at, end_at) without overlaps, cut at midnight; ends are exclusive, empty ones are left out."""
    w = Window.partitionBy("day").orderBy("start_at", "end_at")
    day = F.col("day").cast("timestamp_ntz")
    cut = windows.filter("start_at < end_at").select(F.col("start_at").cast("timestamp_ntz").alias("a"), F.col("end_at").cast("timestamp_ntz").alias("b"))
    # an end at midnight doesn't touch the next day
    cut = cut.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date(F.col("b") - F.expr("interval 1 microsecond")))))
    cut = cut.select("day", F.greatest("a", day).alias("start_at"), F.least("b", day + F.expr("interval 1 day")).alias("end_at"))
    begins = F.coalesce(F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start_at"), F.lit(True))
    run = F.sum(F.col("_b").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("_b", begins).withColumn("_run", run).groupBy("day", "_run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("_run")


def with_exclusions(df: DataFrame, windows: DataFrame, ts: str, usual: float, inside: float) -> DataFrame:
    """Adds ``is_anomaly`` with a higher bound inside known events, ``windows`` (start_at, end_at; any number, they may overlap).

    One left join by day: a point lies in one of the merged windows at most.
    """
    w = merged_windows(windows).withColumnsRenamed({"day": "_day", "start_at": "_a", "end_at": "_b"})
    at = F.col(ts).cast("timestamp_ntz")
    found = df.join(w, (F.to_date(at) == F.col("_day")) & (at >= F.col("_a")) & (at < F.col("_b")), "left")
    return found.withColumn("is_anomaly", F.col("severity") >= F.when(F.col("_day").isNotNull(), inside).otherwise(usual)).drop("_day", "_a", "_b")


def incidents(alerts: DataFrame, seconds: int) -> DataFrame:
    """Incidents of alerts (ts, event_id, name, severity): correlated alerts with less than ``seconds`` between them are one."""
    grouped = sessions(alerts.withColumn("correlation_group", correlation_group(F.col("name"))), ["correlation_group"], seconds)
    found = grouped.groupBy("correlation_group", "session").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_alerts"), F.max_by("severity", level(F.col("severity"))).alias("severity"))
    return found.select(F.concat_ws("_", "correlation_group", F.date_format("created_at", "yyyyMMdd_HHmmss")).alias("incident_id"), "correlation_group", "created_at", "updated_at", "n_alerts", "severity")


def deduplicated(alerts: DataFrame, fingerprint: Sequence[str], seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``is_duplicate``: less than ``seconds`` after the last alert of the fingerprint that was let through.

    A fold in time order, partitioned by fingerprint; rows stream through in
    Arrow batches, only the last time let through is held.
    """
    keyed = alerts.withColumn("_key", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fingerprint])).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    schema = alerts.schema.add("is_duplicate", "boolean")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = last = None
        for pdf in parts:
            out = []
            for k, us in zip(pdf["_key"], pdf["_us"]):
                if k != key or us - last >= seconds * 1_000_000:
                    key, last = k, us
                    out.append(False)
                else:
                    out.append(True)
            yield pdf.drop(columns=["_key", "_us"]).assign(is_duplicate=out)

    return keyed.repartition("_key").sortWithinPartitions("_key", "_us", tie).mapInPandas(fold, schema)


def match_runbooks(alerts: DataFrame, runbooks: Sequence[tuple[str, Sequence[str], bool]] = RUNBOOKS) -> DataFrame:
    """Adds ``runbook`` (the first that applies, or null) and ``decision``."""
    name = F.lit(None).cast("string")
    approval = F.lit(False)
    for book, names, needs in reversed(runbooks):
        name = F.when(F.col("name").isin(*names), book).otherwise(name)
        approval = F.when(F.col("name").isin(*names), F.lit(needs)).otherwise(approval)
    decision = F.when(name.isNull(), "no_runbook").when(approval, "awaiting_approval").otherwise("execute")
    return alerts.withColumn("runbook", name).withColumn("decision", decision)
