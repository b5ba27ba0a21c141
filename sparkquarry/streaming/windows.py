"""Streaming counterparts of the batch operators; event time is ``ts``, ten minutes late at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "10 minutes"


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; ``ts`` as a timestamp, as watermarks want it."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", delay: str = DELAY) -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "4 minutes 59.999999 seconds", delay: str = DELAY) -> DataFrame:
    """Sessions of a user; the gap is a microsecond short of five minutes, as a session joins at exactly its gap."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and gives back what it wrote to ``path``, a folder that driver and executors share.

    A batch has a folder of its own, so a repeated batch replaces itself; in
    complete mode the last batch is the result.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else number}")

    put(spark.createDataFrame([], stream.schema), -1)
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def upsert_batches(stream: DataFrame, key: str, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Starts a query that hands each batch's newest row of every key to ``apply``: a pending set worked off at intervals."""

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        apply(newest, number)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def drain_in_slices(rows: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], slices: int = 3, at: str = "ts") -> DataFrame:
    """What ``make``, a stream in append mode, writes over ``rows`` that arrive in slices of time; it stops and starts again between them."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    for i in range(slices):
        lo, hi = (low + (high - low) * k / slices for k in (i, i + 1)) if low is not None else (None, None)
        part = rows if low is None else rows.filter((F.col(at) >= F.lit(lo)) & (F.col(at) <= F.lit(hi) if i == slices - 1 else F.col(at) < F.lit(hi)))
        part.write.mode("append").parquet(f"{path}/in")
        out = drain(make(read_events(rows.sparkSession, f"{path}/in", rows.schema, 1000)), path, "append")
    return out
