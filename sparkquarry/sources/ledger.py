"""Long work in ranges of a key, with a ledger of those that are done: it stops anywhere and goes on from there.

The ranges are planned once and kept beside the ledger.  A range's output is
put in its place before the ledger names it, and an entry is created only where
there is none; what was stopped in between is done again and replaces itself.
Ranges that the ledger names are never read again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Storage

#: Gives the value of a row and why it failed (null: it didn't), for an attempt counted from 0.
Transform = Callable[[int], tuple[Column, Column]]


class Ledger:
    """Ranges and finished ranges of one piece of work, in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Storage(spark, root)

    def ranges(self, rows: DataFrame, key: str, n: int) -> list[tuple[int, int | None, int | None]]:
        """(number, from, up to and without): about equally many rows each; planned by whoever comes first. A null key is in the first."""
        if not self.store.exists("plan.json"):
            cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
            cuts = sorted(set(cuts or []))
            self.store.create("plan.json", json.dumps([list(x) for x in zip(range(len(cuts) + 1), [None, *cuts], [*cuts, None])]))
        return [tuple(x) for x in json.loads(self.store.read("plan.json"))]

    def finished(self) -> dict[int, dict]:
        return {int(n.removesuffix(".json")): json.loads(self.store.read(f"done/{n}")) for n in self.store.names("done")}

    def finish(self, number: int, facts: dict) -> bool:
        return self.store.create(f"done/{number:09d}.json", json.dumps({**facts, "at": time.time()}))

    def waves(self, rows: DataFrame, key: str, n: int, wave: int, most: int | None):
        """Unfinished ranges, ``wave`` at a time and ``most`` in all: their numbers, and their rows with the number as ``_range``."""
        done = self.finished()
        todo = [r for r in self.ranges(rows, key, n) if r[0] not in done][:most]
        for i in range(0, len(todo), wave):
            part = todo[i : i + wave]
            conditions = [(number, _between(F.col(key), lo, hi)) for number, lo, hi in part]
            number = reduce(lambda c, x: c.when(x[1], F.lit(x[0])), conditions[1:], F.when(conditions[0][1], F.lit(conditions[0][0])))
            yield [p[0] for p in part], rows.filter(reduce(lambda a, b: a | b, [c for _, c in conditions])).withColumn("_range", number)


def _between(key: Column, low: int | None, high: int | None) -> Column:
    """Whether a key lies in a range; a null key does in the first."""
    inside = (key >= low if low is not None else F.lit(True)) & (key < high if high is not None else F.lit(True))
    return F.coalesce(inside, F.lit(True)) if low is None else inside


def copy_in_ranges(rows: DataFrame, key: str, ledger: Ledger, transform: Transform, fallback: Column, n: int = 64, wave: int = 8, attempts: int = 3, most: int | None = None) -> int:
    """Copies ``rows`` to the ledger's folder, transformed; gives the number of ranges worked on.

    A row that fails is tried again, ``attempts`` times in all.  What fails
    then is written to the side (:func:`failures`) and copied with ``fallback``
    as its value.  ``most`` stops after so many ranges.
    """
    spark, store, worked = rows.sparkSession, ledger.store, 0
    for numbers, part in ledger.waves(rows, key, n, wave, most):
        step, todo, good = f"tmp/{uuid.uuid4().hex}", part, []
        for a in range(attempts):
            value, error = transform(a)
            # written before it is looked at twice: a transform need not give the same again
            todo.withColumns({"_value": value, "_error": error}).write.parquet(f"{store.root}/{step}/{a}")
            out = spark.read.parquet(f"{store.root}/{step}/{a}")
            good.append(out.filter("_error is null").withColumn("_attempts", F.lit(a + 1)))
            bad = out.filter("_error is not null")
            todo = bad.drop("_value", "_error")
        rest = bad.withColumns({"_value": fallback, "_attempts": F.lit(attempts)})
        copied = reduce(DataFrame.unionByName, [*(g.withColumn("_how", F.lit("transformed")) for g in good), rest.withColumn("_how", F.lit("fallback"))])
        copied.drop("_error").write.partitionBy("_range").parquet(f"{store.root}/{step}/copied")
        bad.drop("_value").write.partitionBy("_range").parquet(f"{store.root}/{step}/failed")
        counts = {r["_range"]: r for r in spark.read.parquet(f"{store.root}/{step}/copied").groupBy("_range").agg(F.count("*").alias("n"), F.count_if(F.col("_how") == "fallback").alias("failed")).collect()} if store.names(f"{step}/copied") != ["_SUCCESS"] else {}
        for number in numbers:
            for kind in ("copied", "failed"):
                store.delete(f"{kind}/_range={number}")  # of a run that was stopped here
                if store.exists(f"{step}/{kind}/_range={number}"):
                    store.fs.mkdirs(store.path(kind))
                    store.move(f"{step}/{kind}/_range={number}", f"{kind}/_range={number}")
            c = counts.get(number)
            ledger.finish(number, {"rows": c["n"] if c else 0, "failed": c["failed"] if c else 0})
            worked += 1
        store.delete(step)
    return worked


def _table(ledger: Ledger, kind: str, schema: str) -> DataFrame:
    """Rows of finished ranges alone."""
    done = [f"{ledger.store.root}/{kind}/_range={n}" for n in ledger.finished() if ledger.store.exists(f"{kind}/_range={n}")]
    if not done:
        return ledger.spark.createDataFrame([], schema)
    return ledger.spark.read.schema(schema).parquet(*done)


def copied(ledger: Ledger, rows: DataFrame, value: str) -> DataFrame:
    """The copy so far: the columns of ``rows``, _value (of the DDL type ``value``), _attempts, _how."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return _table(ledger, "copied", f"{kinds}, _value {value}, _attempts int, _how string")


def failures(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """The rows that failed in every attempt, with _error."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return _table(ledger, "failed", f"{kinds}, _error string")


def sums_in_ranges(rows: DataFrame, key: str, ledger: Ledger, partial: dict[str, Column], n: int = 64, wave: int = 8, most: int | None = None) -> int:
    """Evaluates ``rows`` range by range, the partial aggregates of each kept in the ledger; gives the number of ranges worked on."""
    worked = 0
    for numbers, part in ledger.waves(rows, key, n, wave, most):
        found = {r["_range"]: r.asDict() for r in part.groupBy("_range").agg(*[c.alias(x) for x, c in partial.items()]).collect()}
        for number in numbers:
            ledger.finish(number, {x: found[number][x] if number in found else None for x in partial})
            worked += 1
    return worked


def sums(ledger: Ledger, schema: str) -> DataFrame:
    """A row of partial aggregates (``schema``) for each finished range."""
    names = [x.split()[0] for x in schema.split(", ")]
    return ledger.spark.createDataFrame([(k, *[facts[x] for x in names]) for k, facts in sorted(ledger.finished().items())], f"_range int, {schema}")
