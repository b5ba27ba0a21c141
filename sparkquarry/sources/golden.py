"""Golden sets: question, answer and contexts under a name and a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def validated(items: DataFrame, key: str = "question") -> DataFrame:
    """``items``; reading them raises if two have one question."""
    many = items.groupBy(F.xxhash64(key).alias("_k"), key).agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate question: "), F.col(key))).cast("boolean")).otherwise(F.lit(True))
    return items.join(many.withColumn("_ok", ok).select(key, "_ok"), key).filter("_ok").drop("_ok")


def save(items: DataFrame, root: str, name: str, version: str) -> None:
    validated(items).write.mode("error").json(f"{root}/{name}_{version}")


def load(spark: SparkSession, root: str, name: str, version: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{root}/{name}_{version}")
