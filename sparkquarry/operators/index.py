"""A versioned document index: change detection, mutation, versions, migration, cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIB = 1024.0**3


def changes(current: DataFrame, previous: DataFrame, key: str = "doc_id", digest: str = "hash", mtime: str | None = None) -> DataFrame:
    """key, status (new, modified, deleted, unchanged) by one full outer join; an equal modification time, if given, settles it without the hash."""
    c, p = current.alias("c"), previous.alias("p")
    j = c.join(p, F.col(f"c.{key}") == F.col(f"p.{key}"), "full")
    same = F.col(f"c.{digest}").eqNullSafe(F.col(f"p.{digest}"))
    if mtime:
        same = F.coalesce(F.col(f"c.{mtime}") == F.col(f"p.{mtime}"), F.lit(False)) | same
    status = F.when(F.col(f"p.{key}").isNull(), "new").when(F.col(f"c.{key}").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return j.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), status.alias("status"))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``rows`` replace those of ``table`` with the same keys; others are added."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def replace_documents(chunks: DataFrame, fresh: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All chunks of a document that has fresh ones go, so a shorter document leaves no tail."""
    return upsert(chunks, fresh, [doc])


def soft_delete(table: DataFrame, gone: Column, at: Column) -> DataFrame:
    return table.withColumn("deleted", F.coalesce(gone, F.lit(False))).withColumn("deleted_at", F.when(F.col("deleted"), at))


def latest_versions(versions: DataFrame, keep: int, version: str = "version") -> DataFrame:
    """The newest ``keep`` rows of a version list, by number."""
    return versions.orderBy(F.col(version).desc()).limit(keep)


def at_version(log: DataFrame, keys: Sequence[str], version: int, column: str = "version") -> DataFrame:
    """State of an append-only log as of a version: the last row of each key, without those that say deleted."""
    w = Window.partitionBy(*keys).orderBy(F.col(column).desc())
    return log.filter(F.col(column) <= version).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 and not deleted").drop("_rn")


def verify_copy(source: DataFrame, target: DataFrame, key: str, vector: str) -> DataFrame:
    """key, problem (missing, dimension, none) of each source row."""
    d = target.select(F.col(key).alias("_k"), F.size(vector).alias("_n"))
    j = source.join(d, source[key] == d["_k"], "left")
    return j.select(key, F.when(F.col("_k").isNull(), "missing").when(F.size(vector) != F.col("_n"), "dimension").otherwise("none").alias("problem"))


def switch_gate(blue: DataFrame, green: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: counts, their ratio, which side is active: green from ``share`` of blue's rows on."""
    n = blue.agg(F.count("*").alias("n_blue")).join(green.agg(F.count("*").alias("n_green")))
    return n.withColumn("ratio", F.try_divide(F.col("n_green").cast("double"), F.col("n_blue"))).withColumn("active", F.when(F.coalesce(F.col("ratio") >= share, F.lit(False)), "green").otherwise("blue"))


def storage_cost(n: Column, dim: Column, per_gb: float = 0.30) -> tuple[Column, Column]:
    """GB with a fifth for metadata, and dollars a month."""
    gb = n.cast("double") * dim * 4 * 1.2 / GIB
    return gb, gb * per_gb


def backup_cost(gb: Column, every_days: Column, retention_days: Column, per_gb: float = 0.023) -> Column:
    """Dollars a month of retained backups, compressed to a fifth."""
    return gb / 5 * (retention_days / every_days) * per_gb


def run_pipeline(current: DataFrame, previous: DataFrame, failed: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The next state, holding only what was processed, and the retry list: failures keep their old state, so they show as changed again."""
    status = changes(current, previous, key)
    bad = status.filter("status in ('new', 'modified')").join(failed.select(key), key, "left_semi")
    good = status.filter("status in ('new', 'modified')").join(failed.select(key), key, "left_anti")
    kept = previous.join(status.filter("status = 'unchanged'").unionByName(bad).select(key), key, "left_semi")
    return kept.unionByName(current.join(good.select(key), key, "left_semi")), bad.select(key)


def backoff(retries: int, base: float = 1.0, most: float = 60.0) -> list[float]:
    return [min(base * 2**n, most) for n in range(retries)]
