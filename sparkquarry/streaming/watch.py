"""A stream of created, modified and deleted files: consecutive listings of a folder are compared.

Spark's own file stream sees new files alone.  Here an offset names a listing,
kept as a Parquet file in a folder of its own, so that a batch that is run again
compares the same two listings, and a stream that starts again goes on from the
one it had committed.  The folder is listed on the driver, as Spark's file
stream does; listings are compared by tasks, each one for a part of the paths by hash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, length bigint, mtime bigint, listing int"
_LISTING = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.int64()), ("part", pa.int32())])


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there; a local one may be written file:/path, as Hadoop does."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Part(InputPartition):
    before: int
    after: int
    part: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.state = options["path"], options["listings"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.parts = int(options.get("parts", "8"))

    # listings
    def _names(self) -> list[int]:
        files, root = _files(self.state)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".parquet")) for f in found if f.base_name[:1].isdigit())

    def _read(self, number: int, part: int | None) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        files, root = _files(self.state)
        only = None if part is None else [("part", "=", part)]
        t = pq.read_table(f"{root}/{number:09d}.parquet", filesystem=files, filters=only, schema=_LISTING)
        return dict(zip(t["path"].to_pylist(), zip(t["length"].to_pylist(), t["mtime"].to_pylist())))

    def _list(self) -> dict[str, tuple[int, int]]:
        files, root = _files(self.folder)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        plain = (f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return {f.path[len(root) :].lstrip("/"): (f.size, f.mtime_ns or 0) for f in plain if not self.suffixes or f.base_name.endswith(self.suffixes)}

    # the stream
    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self, *_) -> dict:
        last = (self._names() or [0])[-1]
        now = self._list()
        if now == self._read(last, None):
            return {"listing": last}
        files, root = _files(self.state)
        files.create_dir(root, recursive=True)
        rows = [(p, n, t, zlib.crc32(p.encode()) % self.parts) for p, (n, t) in now.items()]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _LISTING)], schema=_LISTING)
        hidden = f"{root}/.{uuid.uuid4().hex}"
        pq.write_table(table, hidden, filesystem=files)
        files.move(hidden, f"{root}/{last + 1:09d}.parquet")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["listing"], end["listing"], k) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        before, after = self._read(partition.before, partition.part), self._read(partition.after, partition.part)
        for path, now in after.items():
            was = before.get(path)
            if was != now:
                yield path, "created" if was is None else "modified", *now, partition.after
        for path, was in before.items():
            if path not in after:
                yield path, "deleted", *was, partition.after

    def commit(self, end: dict) -> None:
        """Listings before the one that is committed are compared with nothing any more; one is kept for a batch that is run again."""
        files, root = _files(self.state)
        for n in self._names():
            if n < end["listing"] - 1:
                files.delete_file(f"{root}/{n:09d}.parquet")


class FolderChanges(DataSource):
    """Options: path, listings (a folder that driver and executors share, outside of path), suffixes (comma-separated), parts."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def folder_changes(spark: SparkSession, path: str, listings: str, suffixes: tuple[str, ...] = (), parts: int = 8) -> DataFrame:
    """A stream of path (below the folder), kind (created, modified, deleted), length, mtime (nanoseconds) and the listing that shows it.

    A file is modified if its length or time differ.  Changes between two
    batches show as their sum: a file that came and went isn't seen.  Hidden
    files (first letter ``.`` or ``_``) are passed over.  At least one batch
    must have been committed before listings of an earlier run are deleted.
    """
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=path, listings=listings, suffixes=",".join(suffixes), parts=str(parts)).load()
