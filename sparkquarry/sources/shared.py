"""The folder that all executors share, as the session names it."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session in local mode, whose tasks share the driver's disk, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """checkpoint() writes to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
