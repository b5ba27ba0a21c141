"""Messages: a broker's topic, or a folder into which a web hook's calls are written as JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic(spark: SparkSession, servers: str, name: str, schema: str, starting: str = "latest") -> DataFrame:
    """A stream of a broker's topic, values parsed as JSON. The connector is Spark's own package and must be on the session's class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", starting).load()
    return parsed(raw.selectExpr("cast(value as string) value", "timestamp"), schema)


def parsed(messages: DataFrame, schema: str) -> DataFrame:
    """``value`` as columns of ``schema``; what is no such JSON comes out with nulls and its text in ``_corrupt``."""
    found = messages.select("value", F.from_json("value", schema).alias("m"))
    return found.select("m.*", F.when(F.col("m").isNull() | (F.to_json("m") == "{}"), F.col("value")).alias("_corrupt"))


def enqueue(messages: DataFrame, path: str) -> None:
    """What a web hook does: each row one JSON line of the queue folder."""
    messages.select(F.to_json(F.struct(*messages.columns)).alias("value")).write.mode("append").text(path)


def queue(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """A stream of the queue folder."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files).text(path), schema)


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every batch that is there to ``handle`` (which must take a repeated batch), tasks in parallel, and ends."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
