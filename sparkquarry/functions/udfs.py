"""Functions by name for SQL: a scalar one, an aggregate of two steps, a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

#: An exact sum counts in this fraction of one, the smallest double.
UNIT_BITS = 1074


@F.pandas_udf(StringType())
def exact_partial(value: pd.Series) -> str:
    """The sum of a batch of doubles without any rounding, as an integer (hexadecimal) of units; nulls are left out.

    Doubles are integers times powers of two; those of one power are added up
    as integers, in two halves that can't overflow below 2^31 values.
    """
    import numpy as np

    x = value.dropna().to_numpy(float)
    if not np.isfinite(x).all():
        raise ValueError("an exact sum is one of finite numbers")
    mantissa, power = np.frexp(x)
    whole = (mantissa * 2.0**53).astype(np.int64)
    power = np.maximum(power.astype(np.int64) - 53, -1074)
    whole = np.where(x == 0, 0, np.ldexp(x, -power).astype(np.int64)) if (power == -1074).any() else whole
    powers, which = np.unique(power, return_inverse=True)
    low, high = np.zeros(len(powers), np.int64), np.zeros(len(powers), np.int64)
    np.add.at(low, which, whole & 0xFFFFFFFF)
    np.add.at(high, which, whole >> 32)
    return hex(sum(((int(h) << 32) + int(lo)) << int(p) + 1074 for p, lo, h in zip(powers, low, high)))


@F.pandas_udf(DoubleType())
def exact_total(parts: pd.Series) -> pd.Series:
    """The double next to the sum of partial sums (an array of them for each row); of none 0."""
    return pd.Series([sum(int(x, 16) for x in p) / (1 << 1074) if p is not None else None for p in parts], dtype="float64")


@F.udtf(returnType=StructType().add("part", StringType()).add("place", IntegerType()))
class Parts:
    """Rows of a text's parts between commas."""

    def eval(self, text: str):
        for i, part in enumerate((text or "").split(",")):
            yield part, i


def register(spark: SparkSession) -> None:
    """Makes them known to SQL.

    ``n_characters(text)`` is an expression by name.  ``exact_partial(value)``
    is an aggregate over a group's batch, which one task holds: it is meant for
    groups that were cut small, whose results ``exact_total(collect_list(...))``
    adds up; the sum is the same however rows were dealt.  ``parts(text)``
    is a table function.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION n_characters(text STRING) RETURNS BIGINT RETURN length(text)")
    spark.udf.register("exact_partial", exact_partial)
    spark.udf.register("exact_total", exact_total)
    spark.udtf.register("parts", Parts)
