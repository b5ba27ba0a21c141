"""Tables of relational databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table, or a query in brackets, over JDBC; with ``column`` in ``parts`` ranges at once. Filters and columns reach the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column is not None:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def append_table(df: DataFrame, url: str, table: str, connections: int = 8, **options: str) -> None:
    """Appends rows over ``connections`` connections at most, such as metric points for reports."""
    df.coalesce(connections).write.format("jdbc").mode("append").option("url", url).option("dbtable", table).options(**options).save()
