"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables by name, read when asked for; timestamps are session-zone timestamps."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, floats: tuple[str, ...] = ()):
    """Registers ``f(tables) -> DataFrame`` under its name. ``floats`` are rounded to 6 places on both sides, as sums of doubles depend on their order; what is added first decides exact halves."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in floats}) if floats else df

        QUERIES[f.__name__] = run
        if sql is not None:
            replace = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in floats)
            ORACLE[f.__name__] = f"SELECT * REPLACE ({replace}) FROM ({sql}) q" if floats else sql
        return f

    return add
