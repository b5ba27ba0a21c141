"""Helpers shared by the operators of this subpackage.

Row identity.  Operators read an integer id column and a text column.  A null
id is carried as ``NULL_ID`` (the smallest long) inside an operator and comes
out as null again, so that joins and minima stay well defined; a null text is
an empty text.  Columns are always selected by name into fresh frames, hence
extra input columns can't clash with the operators' own names.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_ID = -(2**63)
#: Sub-groups into which a group's rows are dealt before its totals return to them.
SALTS = 64


def col(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, dots and all."""
    return df[f"`{name}`"]


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid`` (never null) and ``text`` (never null), nothing else."""
    return df.select(
        F.coalesce(col(df, id_col).cast("long"), F.lit(NULL_ID)).alias("rid"),
        F.coalesce(col(df, text_col).cast("string"), F.lit("")).alias("text"),
    )


def id_out(rid: Column | str = "rid") -> Column:
    rid = F.col(rid) if isinstance(rid, str) else rid
    return F.when(rid == NULL_ID, F.lit(None).cast("long")).otherwise(rid)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as ``spark.checkpoint.dir`` names it.

    Only a session in local mode, whose tasks share the driver's disk, may leave it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return found.rstrip("/")


#: Tables written inside each open :func:`temporary` block, innermost last.
_blocks: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that :func:`written` made inside, but those passed to the function it yields.

    For a caller who has stored an operator's result: the steps behind it
    must outlive a lazy result, so no operator can delete its last ones.
    """
    block: list[DataFrame] = []
    _blocks.append(block)

    def keep(df: DataFrame) -> DataFrame:
        block[:] = [x for x in block if x._step_path != df._step_path]
        for outer in _blocks[-2:-1]:
            outer.append(df)
        return df

    try:
        yield keep
    finally:
        _blocks.remove(block)
        discard(*block)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._step_path = path
    for block in _blocks[-1:]:
        block.append(found)
    return found


def discard(*steps: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing will read again."""
    for df in steps:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._step_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished rounds.

    It does so when the driver's JVM collects garbage, of its own accord only
    every half hour; till then a loop's rounds would all stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def group_totals(
    df: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    final: dict[str, Column],
    spread: Column,
    keep: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Joins totals of a group to each of its rows without meeting the group in one task.

    Rows are dealt to ``salts`` sub-groups by ``spread``; ``partial`` are the
    aggregates of a sub-group, ``final`` those of a group over them.  A
    group's totals go back to just the sub-groups that it has, so the join key
    is (keys, salt) and the rows of the largest group meet in no task.
    ``keep``, over the final columns, drops whole groups.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    sub = df.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    totals = sub.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()], F.collect_list("_salt").alias("_salts"))
    if keep is not None:
        totals = totals.filter(keep)
    totals = totals.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return df.join(totals, [*keys, "_salt"]).drop("_salt")


def spread_join(df: DataFrame, key: str, table: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row for each ``key``: the rows of a hot key are dealt to ``salts`` tasks. Inner join."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return df.join(df.select(key, "_salt").distinct().join(table, key), [key, "_salt"]).drop("_salt")


def keep_rows(df: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False, **more: Column) -> DataFrame:
    """The rows of ``df``, all columns, whose id and text are among ``kept`` (rid, h); of rows that share both only one, if ``once``.

    ``more`` names further columns of ``kept`` and what they are in ``df``.
    The row that stays is the first in the order of all columns, nulls
    first, so the choice doesn't depend on how rows are dealt.  Rows travel as
    one struct beside their keys, hence no column name can clash.  Spark
    limits a window's rows to the first before its shuffle, so a hot key
    sends one row of each task.  Nulls in ``more`` match nothing.
    """
    keys = {"rid": F.coalesce(col(df, id_col).cast("long"), F.lit(NULL_ID)), "h": F.xxhash64(F.coalesce(col(df, text_col).cast("string"), F.lit("")))} | more
    rows = df.select(F.struct(*[col(df, c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])
    found = rows.join(kept.select(*keys).distinct(), list(keys), "left_semi")
    if once:
        # maps have no order of their own
        order = [F.to_json(F.struct(F.col("row").getField(f.name))) if "map<" in f.dataType.simpleString() else F.col("row").getField(f.name) for f in df.schema]
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("rid", "h").orderBy(*order))).filter("nth = 1")
    return found.select("row.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components, a written table: (node, root) with the smallest node reachable, for nodes of ``edges`` (u, v).

    Alternates large-star and small-star steps, each two grouped minima with
    salted joins, until no root points further; every step is a written
    table.  Rounds grow with the logarithm of the longest path.
    """

    def star(pairs: DataFrame) -> DataFrame:
        return group_totals(pairs, ["u"], {"_m": F.min("v")}, {"m": F.min("_m")}, F.col("v"))

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")
    for _ in range(max_rounds):
        # done when every edge leads to a root: no v is a u, and no u has two roots
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("k")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("k")))
        if ends.groupBy("x").agg(F.min("k").alias("lo"), F.sum("k").alias("n")).filter("n > 1 or (lo = 0 and n > 0)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).select("u", "v", F.least("u", "m").alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, large = e, large.filter("u <> v").distinct()
        small = star(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").filter("u <> v").distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = written(found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    discard(e)
    return found
