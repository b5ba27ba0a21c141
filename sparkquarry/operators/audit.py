"""A tamper-evident audit log: hashes, chains, retention, erasure, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import anonymous_id

#: Days that events of a classification are kept.
RETENTION = {"public": 90, "internal": 365, "confidential": 2555, "restricted": 2555}
#: The fields that are hashed, in the order of their names.
HASHED = ("action", "event_id", "event_type", "outcome", "resource_id", "resource_type", "timestamp", "user_id")


def canonical(fields: dict[str, Column]) -> Column:
    """JSON text with sorted keys and spaces after colons and commas; values are strings without quotes."""
    parts = [F.concat(F.lit(f'"{k}": "'), F.coalesce(fields[k].cast("string"), F.lit("")), F.lit('"')) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical(fields), 256)


def event_type(path: Column, method: Column) -> Column:
    """Ordered rules; what none covers is access."""
    return (
        F.when(path.contains("/query"), "document.query").when(path.contains("/documents") & (method == "GET"), "document.access").when(path.contains("/documents") & (method == "POST"), "document.upload")
        .when(path.contains("/documents") & (method == "DELETE"), "document.delete").when(path.contains("/data-export"), "data.export").when(path.contains("/data-deletion"), "data.deletion").otherwise("document.access")
    )


def chained(events: DataFrame, stream: Sequence[str], order: Sequence[str], digest: str = "content_hash") -> DataFrame:
    """Adds ``previous_hash`` along each stream's order; null at its beginning."""
    return events.withColumn("previous_hash", F.lag(digest).over(Window.partitionBy(*stream).orderBy(*order)))


def verified(log: DataFrame, stream: Sequence[str], order: Sequence[str], recomputed: Column | None = None) -> DataFrame:
    """Adds ``link_ok`` (the previous hash is the one before) and ``content_ok`` (the stored hash is the content's)."""
    before = F.lag("content_hash").over(Window.partitionBy(*stream).orderBy(*order))
    out = log.withColumn("link_ok", F.col("previous_hash").eqNullSafe(before))
    return out.withColumn("content_ok", F.lit(True) if recomputed is None else F.col("content_hash") == recomputed)


def expiry(classification: Column, at: Column, as_of: Column) -> Column:
    """Whether an event is past its classification's time; null and unknown ones count as internal."""
    days = F.lit(RETENTION["internal"])
    for name, d in RETENTION.items():
        days = F.when(classification == name, d).otherwise(days)
    return F.date_diff(F.to_date(as_of), F.to_date(at)) > days


def lifecycle_phase(at: Column, as_of: Column) -> Column:
    age = F.date_diff(F.to_date(as_of), F.to_date(at))
    return F.when(age >= 365, "delete").when(age >= 90, "cold").when(age >= 30, "warm").otherwise("hot")


def anonymised(events: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """The user's id as text, hashed for those in ``users``."""
    u = users.select(F.col(user).alias("_u")).distinct().withColumn("_gone", F.lit(True))
    j = events.join(u, events[user] == F.col("_u"), "left")
    return j.withColumn(user, F.when(F.col("_gone"), anonymous_id(F.col(user))).otherwise(F.col(user).cast("string"))).drop("_u", "_gone")


def reconciled(per_user: DataFrame, events: DataFrame, count: str = "n") -> DataFrame:
    """One row: the report's total, the log's, whether they agree."""
    return per_user.agg(F.coalesce(F.sum(count), F.lit(0)).alias("reported")).join(events.agg(F.count("*").alias("logged"))).withColumn("agrees", F.col("reported") == F.col("logged"))


def erased(tables: dict[str, tuple[DataFrame, str]], users: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the users' rows, and the action log: table, n_deleted, status."""
    left, log = {}, None
    for name, (df, col) in tables.items():
        ids = users.select(F.col(key).alias(col)).distinct()
        left[name] = df.join(ids, col, "left_anti")
        row = df.join(ids, col, "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(name).alias("table_name"), "n_deleted", F.when(F.col("n_deleted") > 0, "COMPLETED").otherwise("NO_DATA_FOUND").alias("status"))
        log = row if log is None else log.unionByName(row)
    return left, log
