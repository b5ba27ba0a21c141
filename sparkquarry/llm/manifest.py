"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the digest of its fields.  The leaves of a group (a source),
in the order of ids, form a tree of ``arity``; the groups' roots, in the order
of groups, form another, whose root stands for the dataset.  The proof of a
row is the digests beside its path, from its own run up to the root.

A node is known by its coordinates (tree, level, position), so the siblings of
a path follow from a position and the tree's size alone: rows explode the
coordinates they need, join the node table, put the digests in order and fold.

Scale.  Texts are read once.  Leaves are dealt by range, each task's rows get
their positions from counts of tasks, so a group of any size is spread.  Trees
are built, and proofs looked up, ``STEP`` levels at a time: a block of
``arity ** STEP`` nodes is one group, its inner nodes are asked for by rows of
the block alone, and what lies above is found once for the block, not for each
of its rows.  A node near the root is thus never the join key of a third of
all rows, and nothing is broadcast or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, written

#: Levels of a tree that are built, or looked up, in one round.
STEP = 5
#: Rows that are numbered in one task.
ROWS_PER_TASK = 50_000


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def field(value: Column) -> Column:
    """A field without ambiguity: its size in bytes, a colon and itself; ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def tampered(text: Column, key: Column) -> Column:
    """The text as a check finds it: without line feeds where the checksum of the key is even; null if that changes nothing."""
    return F.when((F.crc32(F.encode(key.cast("string"), "UTF-8")) % 2 == 0) & F.contains(text, F.lit("\n")), F.replace(text, F.lit("\n"), F.lit("")))


def dealt(rows: DataFrame, order: list[str], name: str, per_task: int) -> DataFrame:
    """``rows``, a stored table, in ranges of ``order``, as a written table with ``pid``, the number of the range."""
    tasks = max(2, -(-rows.count() // per_task))
    return written(rows.repartitionByRange(tasks, *order).withColumn("pid", F.spark_partition_id()), name)


def placed(rows: DataFrame, cells: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` of :func:`dealt` with ``pos`` in their group (``key``), from 0, and the other columns of ``cells`` (pid, key, first, ...)."""
    nth = F.row_number().over(Window.partitionBy("pid", "key").orderBy(*order))
    return rows.withColumn("nth", nth).join(cells, ["pid", "key"]).withColumn("pos", F.col("first") + F.col("nth") - 1).drop("nth", "first", "pid")


def with_offsets(cells: DataFrame) -> DataFrame:
    """``cells`` (pid, key, rows, ...) with ``first``, the group's rows in earlier ranges, and ``n``, all of them."""
    earlier = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns({"first": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("key"))}).drop("rows")


class Shape:
    """Coordinates of a tree over ``n`` leaves in which ``arity`` consecutive nodes make one of the next level, until one is left."""

    def __init__(self, arity: int, step: int = STEP) -> None:
        self.arity, self.step = arity, step
        powers = [1]
        while powers[-1] * arity < 2**62:
            powers.append(powers[-1] * arity)
        self.powers = F.array(*[F.lit(p).cast("long") for p in powers])
        self.n_powers = len(powers)
        self.block = arity**step

    def power(self, k: Column) -> Column:
        return F.element_at(self.powers, k + 1)

    def depth(self, n: Column) -> Column:
        """Levels above the leaves."""
        return F.size(F.filter(self.powers, lambda p: p < n))

    def depth_of(self, n: int) -> int:
        d = 0
        while self.arity**d < n:
            d += 1
        return d

    def width(self, n: Column, level: Column) -> Column:
        """Nodes of a level."""
        return div(n - 1, self.power(level)) + 1


def raised(nodes: DataFrame, shape: Shape, base: int) -> DataFrame:
    """tree, n, level, pos, digest of the next ``STEP`` levels above ``nodes`` (tree, n, pos, digest), which lie at level ``base``."""
    a, step = shape.arity, shape.step
    blocks = nodes.groupBy("tree", "n", F.expr(f"pos div {shape.block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("a"))
    run = lambda last, i: F.sha2(F.array_join(F.slice(last, i * a + 1, a), ""), 256)
    above = lambda last: F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / a).cast("int")), lambda i: run(last, i))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(step)), F.array(F.transform("a", lambda x: x["digest"])), lambda found, _: F.concat(found, F.array(above(F.element_at(found, -1)))))
    out = blocks.select("tree", "n", "block", F.posexplode(levels).alias("up", "digests")).filter((F.col("up") > 0) & (F.col("up") + base <= shape.depth(F.col("n"))))
    out = out.select("tree", "n", "block", "up", F.posexplode("digests").alias("i", "digest"))
    return out.select("tree", "n", (F.col("up") + base).alias("level"), (F.col("block") * shape.power(F.lit(step) - F.col("up")) + F.col("i")).alias("pos"), "digest")


def looked_up(nodes: DataFrame, table: DataFrame, shape: Shape, base: int) -> DataFrame:
    """tree, n, pos, steps: for ``nodes`` at level ``base``, the digests ``before`` and ``after`` the path in its run at each of ``STEP`` levels.

    ``table`` holds the nodes (tree, level, pos, digest) of these levels.
    """
    n, pos = F.col("n"), F.col("pos")
    levels = F.sequence(F.lit(base), F.least(F.lit(base + shape.step), shape.depth(n)) - 1)
    own = lambda level: div(pos, shape.power(level - base))
    first = lambda level: own(level) - F.pmod(own(level), F.lit(shape.arity))
    run = lambda level: F.sequence(first(level), F.least(first(level) + shape.arity, shape.width(n, level)) - 1)
    beside = lambda level: F.transform(F.filter(run(level), lambda p: p != own(level)), lambda p: F.struct(level.alias("level"), p.alias("at")))
    asked = nodes.select("tree", "n", "pos", F.explode_outer(F.flatten(F.transform(levels, beside))).alias("c")).select("tree", "n", "pos", F.col("c.level").alias("level"), F.col("c.at").alias("at"))
    found = asked.join(table.select("tree", "level", F.col("pos").alias("at"), "digest"), ["tree", "level", "at"], "left")
    found = found.groupBy("tree", "n", "pos").agg(F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "at", "digest")))).alias("found"))
    part = lambda level, side: F.array_join(F.transform(F.filter("found", lambda x: (x["level"] == level) & side(x["at"], own(level))), lambda x: x["digest"]), "")
    steps = F.transform(levels, lambda level: F.struct(part(level, lambda p, o: p < o).alias("before"), part(level, lambda p, o: p > o).alias("after")))
    return found.select("tree", "n", "pos", steps.alias("steps"))


class Forest:
    """Trees over ``nodes`` (tree, n, pos, digest; a stored table, ``pos`` from 0 without gaps in each of the trees)."""

    def __init__(self, nodes: DataFrame, arity: int, step: int = STEP) -> None:
        self.shape = Shape(arity, step)
        self.deepest = self.shape.depth_of(nodes.agg(F.max("n")).first()[0] or 0)
        self.chunks = [nodes.select("tree", "n", F.lit(0).alias("level"), "pos", "digest")]
        while (base := step * (len(self.chunks) - 1)) < self.deepest:
            below = self.chunks[-1].filter((F.col("level") == base) & (self.shape.depth(F.col("n")) > base))
            self.chunks.append(written(raised(below, self.shape, base), "nodes"))

    def tops(self) -> DataFrame:
        """tree, n, digest of each tree's root."""
        found = self.chunks[0].filter("n = 1")
        for chunk in self.chunks[1:]:
            found = found.unionByName(chunk.filter(F.col("level") == self.shape.depth(F.col("n"))))
        return found.select("tree", "n", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, n, pos, steps and the other columns of ``above`` (tree, n, steps, ...) for every leaf: its steps, then those above its tree."""
        more = [c for c in above.columns if c not in ("tree", "n", "steps")]
        names = ["tree", "n", "pos", "steps", *more]
        roots = above.withColumn("pos", F.lit(0).cast("long")).select(*names)
        found, step = roots, self.shape.step
        for c in range(len(self.chunks) - 2, -1, -1):
            base, deep = c * step, self.shape.depth(F.col("n"))
            nodes = self.chunks[c].filter((F.col("level") == base) & (deep > base))
            inner = nodes.unionByName(self.chunks[c + 1].filter(F.col("level") < base + step)) if step > 1 else nodes
            mine = looked_up(nodes, inner, self.shape, base).withColumn("block", F.expr(f"pos div {self.shape.block}"))
            upper = found.filter(deep > base).select("tree", F.col("pos").alias("block"), F.col("steps").alias("upper"), *more)
            mine = mine.join(upper, ["tree", "block"]).withColumn("steps", F.concat("steps", "upper")).select(*names)
            found = mine.unionByName(roots.filter(deep <= base))
        return found


def merkle_manifest(
    docs: DataFrame, arity: int = 3, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    text_col: str = "text", per_task: int = ROWS_PER_TASK, step: int = STEP,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per input row.

    ``folded_root`` is computed anew from the row as a check finds it
    (:func:`tampered`) and the original siblings; ``verified`` says whether it
    is the root.  Null fields are digested as ``-``, so they differ from empty
    ones; a null group is a group of its own, the first; null ids come first
    in their group and are never tampered with.  Rows with one group and id
    are ordered by leaf; repeated rows have equal leaves, each in its own
    place.  A field that is missing from ``docs`` counts as null.  An empty
    table has no rows, hence no root.
    """
    parts = {c: (col(docs, c).cast("string") if c in docs.columns else F.lit(None).cast("string")) for c in dict.fromkeys((*fields, id_col, group_col, text_col))}
    key, found_text = parts[id_col], tampered(parts[text_col], parts[id_col])
    leaf = digest(*[field(parts[c]) for c in fields])
    changed = digest(*[field(found_text if c == text_col else parts[c]) for c in fields])
    order = ["source", "doc_id", "leaf"]
    rows = docs.select(parts[group_col].alias("source"), col(docs, id_col).alias("doc_id"), field(parts[group_col]).alias("key"), leaf.alias("leaf"), F.when(found_text.isNotNull(), changed).alias("changed"))
    rows = dealt(written(rows, "leaves"), order, "dealt", per_task)
    # groups in their order are the leaves of the upper tree
    cells = with_offsets(rows.groupBy("pid", "key").agg(F.count("*").alias("rows")))
    groups = dealt(written(rows.groupBy("key").agg(F.first("source").alias("source"), F.count("*").alias("size")), "groups"), ["source"], "groups", per_task)
    of_groups = with_offsets(groups.groupBy("pid").agg(F.count("*").alias("rows")).withColumn("key", F.lit("")))
    numbers = placed(groups.withColumnRenamed("key", "group").withColumn("key", F.lit("")), of_groups, ["source"])
    groups = written(numbers.select(F.col("group").alias("key"), "size", "pos", "n"), "groups")
    cells = cells.join(groups.select("key", F.col("pos").alias("tree")), "key")
    rows = written(placed(rows, cells, order).select("tree", "n", "pos", "doc_id", "leaf", "changed"), "leaves")
    trees = Forest(rows.select("tree", "n", "pos", F.col("leaf").alias("digest")), arity, step)
    tops = written(trees.tops(), "tops")
    one = F.lit(0).cast("long")
    upper = Forest(written(groups.join(tops.select(F.col("tree").alias("pos"), "digest"), "pos").select(one.alias("tree"), "n", "pos", "digest"), "subroots"), arity, step)
    root = upper.tops().select("tree", "n", F.array().cast("array<struct<before:string,after:string>>").alias("steps"), F.col("digest").alias("root"))
    above = upper.paths(root).select(F.col("pos").alias("tree"), "steps", "root")
    above = written(tops.withColumnRenamed("digest", "subroot").join(above, "tree").select("tree", "n", "steps", "subroot", "root"), "above")
    paths = trees.paths(above).drop("n")
    out = rows.join(paths, ["tree", "pos"])
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("changed", "leaf"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
