"""Backups in parts of bounded size: each part a file with a checksum, nothing counts before the marker is there."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import total_before
from .storage import Storage

MARKER = "_COMMITTED"


def in_parts(rows: DataFrame, key: str, size: Column, part_bytes: int) -> DataFrame:
    """``rows`` with ``_size`` and ``_part``: in the order of ``key``, which must be unique, a part begins with the first row at or after each multiple of ``part_bytes``."""
    sized = total_before(rows.withColumn("_size", size.cast("long")), [key], "_size", "_at")
    return sized.withColumn("_part", F.expr(f"_at div {part_bytes}")).drop("_at")


def _digest(line: Column) -> Column:
    """A number of 60 bits; their sum over a part doesn't depend on the order of its lines, and copies don't cancel out."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")


def _summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("part").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value").cast("long") + 1).alias("n_text"), F.sum(_digest(F.col("value"))).alias("checksum"))


def backup_parts(rows: DataFrame, path: str, key: str, size: Column, part_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Writes gzip JSON lines in parts, a manifest of parts and, last, the marker; gives the manifest (part, n, bytes, first, last).

    Tasks that fail are run again by Spark; if the job fails what was written
    is taken back, and a backup without its marker is none.
    """
    spark = rows.sparkSession
    store = Storage(spark, path)
    if store.exists(MARKER):
        raise FileExistsError(f"{path} holds a backup already")
    columns = rows.columns
    try:
        parts = in_parts(rows, key, size, part_bytes)
        lines = parts.select(F.col("_part").alias("part"), F.col(key).alias("_key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("value"))
        # the tasks that write hold whole parts, so a part is one file
        n_parts = (parts.agg(F.max("_part")).first()[0] or 0) + 1
        lines.repartition(n_parts, "part").sortWithinPartitions("part", "_key").drop("_key").write.mode("overwrite").partitionBy("part").option("compression", "gzip").text(f"{path}/data")
        facts = parts.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"), F.sum("_size").alias("bytes"), F.min(key).alias("first"), F.max(key).alias("last"))
        facts.join(_summary(lines), "part", "left").write.mode("overwrite").parquet(f"{path}/manifest")
    except Exception:
        for name in ("data", "manifest"):
            store.delete(name)
        raise
    manifest = spark.read.parquet(f"{path}/manifest")
    total = manifest.agg(F.count("*").alias("parts"), F.sum("n").alias("rows")).first()
    if not store.create(MARKER, json.dumps({"parts": total["parts"], "rows": total["rows"] or 0, "at": time.time()})):
        raise FileExistsError(f"{path} holds a backup already")
    return manifest.select("part", "n", "bytes", "first", "last")


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, problem (missing, changed, unknown) of parts that aren't as the manifest has them."""
    want = spark.read.parquet(f"{path}/manifest")
    store = Storage(spark, path)
    if want.isEmpty() and not any(n.startswith("part=") for n in store.names("data")):
        return spark.createDataFrame([], "part bigint, problem string")
    found = spark.createDataFrame([], "value string, part bigint") if not any(n.startswith("part=") for n in store.names("data")) else spark.read.schema("value string, part bigint").text(f"{path}/data")
    got = _summary(found).select("part", F.struct("n_lines", "n_text", "checksum").alias("got"))
    both = want.select("part", F.struct("n_lines", "n_text", "checksum").alias("want")).join(got, "part", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(~F.col("got").eqNullSafe(F.col("want")), "changed")
    return both.select("part", problem.alias("problem")).filter("problem is not null")


def restore_parts(spark: SparkSession, path: str, schema: str, verify: bool = True) -> DataFrame:
    """The rows of a backup and their ``part``; raises if it was never finished or a part isn't as it was written."""
    store = Storage(spark, path)
    if not store.exists(MARKER):
        raise ValueError(f"{path} holds no finished backup")
    if verify:
        bad = damaged_parts(spark, path).orderBy("part").limit(5).collect()
        if bad:
            raise ValueError(f"{path} is damaged: " + ", ".join(f"part {r['part']} {r['problem']}" for r in bad))
    if not any(n.startswith("part=") for n in store.names("data")):
        return spark.createDataFrame([], f"{schema}, part bigint")
    return spark.read.schema("value string, part bigint").text(f"{path}/data").select(F.from_json("value", schema).alias("r"), "part").select("r.*", "part")
