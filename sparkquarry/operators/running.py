"""Running totals over a whole table, with no task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def total_before(rows: DataFrame, order: list[str], value: str, name: str, per_task: int = 200_000) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows before each in ``order``, which must tell all rows apart.

    Rows are dealt by range and written, so that a range holds the same rows
    whenever it is read; each range's total gives the offset of the later ones.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "ranges")
    tasks = max(1, -(-rows.count() // per_task))
    rows.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    # a row for each range
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_all"))
    offsets = totals.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_first"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_sum", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, "_range").withColumn(name, F.col("_first") + F.col("_sum")).drop("_range", "_first", "_sum")
