"""Small files on whatever file system a path names, through the session's Hadoop file systems."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Storage:
    """Files below ``root``; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, in order; nothing if it doesn't exist. Names with a leading dot are unfinished."""
        if not self.exists(folder):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))]
        return sorted(n for n in found if not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Creates a whole file, unless there is one of that name: of several writers just one gets True, and readers never see part of it.

        A hidden file is renamed without overwriting, which the file systems
        of clusters do as one step; a local one makes a link, as its rename
        doesn't look. A store whose rename is a copy needs a lock around this.
        """
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/.{last}-{uuid.uuid4().hex}"
        self._write(hidden, text)
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda n: self.jvm.java.nio.file.Path.of(self.path(n).toUri().getPath(), self._none())
                self.jvm.java.nio.file.Files.createLink(local(name), local(hidden))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
                options = self.jvm.java.lang.reflect.Array.newInstance(kind, 0)
                context.rename(self.path(hidden), self.path(name), options)
            return True
        except Py4JJavaError as e:
            if self.exists(name):
                return False
            raise e
        finally:
            self.delete(hidden)

    def _none(self):
        return self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last written to."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{self.root}/{a} could not be moved to {b}")


@contextmanager
def exclusive(storage: Storage, name: str, timeout: float = 30.0, stale: float = 3600.0, poll: float = 0.1) -> Iterator[None]:
    """Holds the lock file ``name``; raises TimeoutError if another holds it so long. A lock older than ``stale`` seconds was left by a dead holder and is broken."""
    until, holder = time.monotonic() + timeout, uuid.uuid4().hex
    while not storage.create(name, holder):
        try:
            if storage.age(name) > stale:
                # of several breakers one moves it away
                storage.move(name, f"{name}.{holder}.broken")
                storage.delete(f"{name}.{holder}.broken")
                continue
        except (OSError, Py4JJavaError):
            continue  # released meanwhile
        if time.monotonic() >= until:
            raise TimeoutError(f"{storage.root}/{name} is held by another")
        time.sleep(poll)
    try:
        yield
    finally:
        if storage.exists(name) and storage.read(name) == holder:
            storage.delete(name)
