"""Hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_interval(key: Column) -> Column:
    """The first 8 hex digits of the MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hashed_order(*parts: Column) -> Column:
    """A sort key that stands in for a random order and is the same everywhere."""
    return F.md5(F.concat_ws(":", *parts))


def anonymous_id(user: Column) -> Column:
    return F.concat(F.lit("anon_"), F.substring(F.sha2(user.cast("string"), 256), 1, 12))


def fingerprint(name: Column, labels: Column) -> Column:
    """MD5 of a name and its sorted labels (a map)."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.md5(F.concat(name, F.lit(":"), F.array_join(pairs, ",")))
