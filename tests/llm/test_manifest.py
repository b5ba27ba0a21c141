"""The Merkle manifest beside a plain one: trees, proofs, tampering and edges."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h(*[field(row[c]) for c in FIELDS])


def tree(leaves, arity):
    """Levels, and the (before, after) digests of each leaf's path."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            a = i // arity * arity
            path.append(("".join(level[a:i]), "".join(level[i + 1 : a + arity])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, within = {}, {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroots[s], within[s] = tree([leaf(r) for r in groups[s]], arity)
    root, above = tree([subroots[s] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], within[s]):
            path = path + above[k]
            found = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                found["text"] = r["text"].replace("\n", "")
            x = leaf(found)
            for before, after in path:
                x = h(before, x, after)
            out.append((r["doc_id"], leaf(r), subroots[s], root, h(*[b + a for b, a in path]), x, x == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [(i, ["a", "b", None, "é", "Z"][i * i % 5], "en" if i % 3 else None, i if i % 4 else None, f"line {i}\nend" if i % 7 else None) for i in range(60)]
ROWS += [(1, "b", "en", 1, "line 1\nend")] * 5 + [(None, None, None, None, None)] * 2 + [(None, "a", "x", 1, "")] + [(99, "lonely", "", 0, "")] + [(100, "big", "en", 9, "long text\n" * 30_000)]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("arity,step,per_task", [(3, 5, 50_000), (3, 1, 7), (2, 2, 10), (7, 3, 3)])
def test_beside_a_plain_tree(spark, arity, step, per_task):
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = df.withColumns({c: F.lit("clash") for c in ("key", "leaf", "pid", "pos", "n", "tree", "steps", "root")})
    assert got(manifest.merkle_manifest(clash, arity, step=step, per_task=per_task)) == plain([r.asDict() for r in df.collect()], arity)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    df = spark.createDataFrame([(i, "s", "en", 1, "a\nb") for i in range(n)], SCHEMA)
    found = got(manifest.merkle_manifest(df, 3, step=2))
    assert found == plain([r.asDict() for r in df.collect()])
    if n == 1:
        assert found[0][4] == h() and found[0][1] == found[0][3]


def test_many_groups(spark):
    df = spark.createDataFrame([(i, f"s{i % 40}" if i % 41 else None, "en", 1, "a\nb") for i in range(120)], SCHEMA)
    assert got(manifest.merkle_manifest(df, 3, step=2, per_task=9)) == plain([r.asDict() for r in df.collect()])


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert manifest.merkle_manifest(df.filter("false")).collect() == []
    bare = df.drop("lang", "source")
    assert got(manifest.merkle_manifest(bare)) == plain([r.asDict() | {"lang": None, "source": None} for r in bare.collect()])


def test_any_change_shows(spark):
    """A change of one row's text changes the root; rows that lost a line feed don't fold to it."""
    df = spark.createDataFrame(ROWS[:30], SCHEMA)
    one = manifest.merkle_manifest(df).collect()
    other = manifest.merkle_manifest(df.withColumn("text", F.when(F.col("doc_id") == 17, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).collect()
    assert one[0]["root"] != other[0]["root"]
    for r in one:
        text = next(x[4] for x in ROWS if x[0] == r["doc_id"])
        assert r["verified"] == (text is None or "\n" not in text or zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1)
