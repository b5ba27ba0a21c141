"""The stream of file changes: three listings, restarts, deletions, an empty folder."""

import os

import pytest

from sparkquarry.streaming import watch


@pytest.fixture
def changes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, text):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def go():
        found = []
        stream = watch.folder_changes(spark, str(folder), str(tmp_path / "listings"), (".txt", ".md"), parts=3)
        q = stream.writeStream.foreachBatch(lambda b, n: found.extend((r["path"], r["kind"], r["length"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(found)

    return folder, put, go


def test_changes(changes):
    folder, put, go = changes
    assert go() == []
    put("a.txt", "1"), put("sub/b.md", "22"), put("c.csv", "no"), put(".hidden.txt", "no"), put("é ö.txt", "1")
    assert go() == [("a.txt", "created", 1), ("sub/b.md", "created", 2), ("é ö.txt", "created", 1)]
    assert go() == []  # a restart repeats none
    put("a.txt", "longer"), put("d.txt", "")
    os.remove(folder / "sub/b.md")
    assert go() == [("a.txt", "modified", 6), ("d.txt", "created", 0), ("sub/b.md", "deleted", 2)]
    os.utime(folder / "d.txt", (1, 1))  # same length, other time
    put("sub/b.md", "33")
    assert go() == [("d.txt", "modified", 0), ("sub/b.md", "created", 2)]
    for f in ("a.txt", "d.txt", "sub/b.md", "é ö.txt"):
        os.remove(folder / f)
    assert {k for _, k, _ in go()} == {"deleted"} and go() == []
