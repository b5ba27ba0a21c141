"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row follows from its key and the number of shards alone: no
ring table is kept, and going from n to n+1 shards moves a row either nowhere
or into the new shard (one row in n+1 on average).  Law: ``key``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, id_out, keyed

#: Rows that are numbered in one task.
ROWS_PER_CELL = 20_000


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in [0, n_shards) of each 64-bit key."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = ahead[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead[live] = ((shard[live] + 1) * (2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[ahead[live] < n_shards]
    return shard


def jump_shard(key, n_shards: int):
    """Column expression: the shard of a long key (a null key counts as the smallest long)."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), n_shards).astype(np.int32))

    return shard(key)


def shard_rows(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    ``slot`` numbers a shard's rows from 0 without gaps: a shard is cut into
    cells by a hash of key, checksum and size (a repeated key's rows are thus dealt out), cells get offsets from their counts, and rows
    are numbered inside their cell, so no task sees a whole shard.  The cells
    number as the rows do.

    Null text: size 1 and checksum 0, as for an empty one.  Null ids share the
    shard of the smallest long.  Repeated ids share a shard and get slots of
    their own.  An empty table gives an empty result.
    """
    base = keyed(docs, id_col, text_col).select(
        "rid",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    # ids alone: the count of rows, of a columnar file's footer
    cells = max(8, -(-docs.select(col(docs, id_col)).count() // (n_shards * ROWS_PER_CELL)))
    placed = base.withColumns({"shard": jump_shard(F.col("rid"), n_shards), "grown_shard": jump_shard(F.col("rid"), n_shards + 1), "cell": F.pmod(F.xxhash64("rid", "text_crc32", "size"), F.lit(cells))})
    per_cell = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("rid", "text_crc32", "size")
    numbered = placed.withColumn("_at", F.row_number().over(inside)).join(offsets, ["shard", "cell"])
    return numbered.select(
        id_out().alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard",
    )
