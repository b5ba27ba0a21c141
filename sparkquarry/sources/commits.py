"""A keyed table under a log of commits: writers that don't know of each other lose no update.

Data files are written first, under a name of their own; nobody sees them
until a numbered manifest names them.  Manifests are created only where none
of that number is, so of two writers one gets the next number and the other
looks at what came in between: if no key that it changes was changed, it takes
the number after that, else it gives up its files and begins again from the new
state.  A writer that dies leaves files that no manifest names.

A version can be reverted by a manifest that says so; readers pass over it.  A
base holds the whole state, so that readers needn't go further back.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Storage


class Conflict(Exception):
    """Another writer changed keys of this change after the state it was made from."""


@dataclass(frozen=True)
class Change:
    """Files that were written from the state of version ``base``, not yet committed."""

    name: str
    base: int


class CommitLog:
    """Rows of ``schema`` (a DDL string) with a unique ``key``, in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str) -> None:
        self.spark, self.key, self.store = spark, key, Storage(spark, root)
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, _gone boolean"

    # the log
    def manifests(self) -> dict[int, dict]:
        return {int(n.removesuffix(".json")): json.loads(self.store.read(f"log/{n}")) for n in self.store.names("log")}

    def latest(self) -> int:
        """The newest version; 0 if there is none."""
        names = self.store.names("log")
        return int(names[-1].removesuffix(".json")) if names else 0

    def _publish(self, version: int, manifest: dict) -> bool:
        return self.store.create(f"log/{version:012d}.json", json.dumps(manifest))

    # reading
    def _data(self, names: dict[str, int]) -> DataFrame:
        """Rows of data folders, with the version of each."""
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, _version bigint")
        paths = [f"{self.store.root}/data/{n}" for n in names]
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/[^/]+$", 1)
        # one row for each commit since the last base
        table = self.spark.createDataFrame(list(names.items()), "_folder string, _version bigint")
        return rows.withColumn("_folder", folder).join(F.broadcast(table), "_folder").drop("_folder")

    def visible(self, version: int | None = None) -> dict[str, int]:
        """Data folders that make up a version, with the version that brought each: from the last base on, without the reverted."""
        log = {v: m for v, m in self.manifests().items() if version is None or v <= version}
        reverted = {m["reverts"] for m in log.values() if m["kind"] == "revert"}
        first = max((v for v, m in log.items() if m["kind"] == "base"), default=0)
        return {m["data"]: v for v, m in log.items() if v >= first and m["kind"] != "revert" and v not in reverted}

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the newest if none is given."""
        rows = self._data(self.visible(version))
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), "_version").alias("_r"))
        return last.select(self.key, "_r.*").filter("not _gone").select(*self.columns)

    # writing
    def write(self, changed: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> Change:
        """Writes new and changed rows, and the keys of those that go; ``base`` is the version they were made from."""
        base = self.latest() if base is None else base
        rows = changed.select(*self.columns).withColumn("_gone", F.lit(False))
        if gone is not None:
            empty = [F.lit(None).cast(t).alias(c) if c != self.key else F.col(c) for c, t in changed.select(*self.columns).dtypes]
            rows = rows.unionByName(gone.select(self.key).distinct().select(*empty).withColumn("_gone", F.lit(True)))
        change = Change(f"{base:012d}-{uuid.uuid4().hex}", base)
        rows.write.parquet(f"{self.store.root}/data/{change.name}")
        return change

    def commit(self, change: Change) -> int:
        """The version under which the change is visible; raises Conflict if keys of it were changed after its base."""
        seen = change.base
        while True:
            log = self.manifests()
            since = {m["data"]: v for v, m in log.items() if v > seen and m["kind"] == "change"}
            reverts = [m for v, m in log.items() if v > seen and m["kind"] == "revert"]
            if since:
                theirs = self._data(since).select(self.key)
                if not self._data({change.name: 0}).join(theirs, self.key, "left_semi").isEmpty():
                    raise Conflict(f"versions {min(since.values())} to {max(since.values())} changed keys of {change.name}")
            if reverts:
                raise Conflict(f"version {reverts[0]['reverts']} was reverted after {change.name} was made")
            seen = max([seen, *log])
            if self._publish(seen + 1, {"kind": "change", "data": change.name, "base": change.base, "at": time.time()}):
                return seen + 1

    def abort(self, change: Change) -> None:
        self.store.delete(f"data/{change.name}")

    def apply(self, make: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], retries: int = 5, wait: float = 0.1) -> int:
        """Commits what ``make`` gives for the newest state (changed rows, keys that go); from the start, if others were faster."""
        for attempt in range(retries + 1):
            base = self.latest()
            change = self.write(*make(self.snapshot(base)), base=base)
            try:
                return self.commit(change)
            except Conflict:
                self.abort(change)
                if attempt == retries:
                    raise
                time.sleep(min(wait * 2**attempt, 60))
        raise AssertionError

    def revert(self, version: int) -> int:
        """Readers pass over ``version`` from now on; a base already holds what lies behind it."""
        while True:
            log = self.manifests()
            if log.get(version, {}).get("kind") != "change" or any(v > version and m["kind"] == "base" for v, m in log.items()):
                raise ValueError(f"{version} is no version that can be reverted")
            n = max(log) + 1
            if self._publish(n, {"kind": "revert", "reverts": version, "at": time.time()}):
                return n

    def compact(self) -> int | None:
        """A base of the newest state; None if others committed meanwhile."""
        at = self.latest()
        name = f"{at:012d}-base-{uuid.uuid4().hex}"
        self.snapshot(at).withColumn("_gone", F.lit(False)).write.parquet(f"{self.store.root}/data/{name}")
        if self._publish(at + 1, {"kind": "base", "data": name, "base": at, "at": time.time()}):
            return at + 1
        self.store.delete(f"data/{name}")
        return None

    def vacuum(self, older: float = 86_400.0) -> list[str]:
        """Deletes data that no manifest names and that hasn't been written to for so many seconds: what dead writers left."""
        named = {m["data"] for m in self.manifests().values() if "data" in m}
        found = [n for n in self.store.names("data") if n not in named and self.store.age(f"data/{n}") >= older]
        for n in found:
            self.store.delete(f"data/{n}")
        return found
