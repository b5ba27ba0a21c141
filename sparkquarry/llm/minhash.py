"""Near-duplicate grouping by min-max hashing (Ji, Li, Yan, Tian, Zhang, 2013).

Every permutation of the shingle hashes gives two signature values, its
minimum and its maximum, so half the hash evaluations fill a signature; both
agree between two sets with probability equal to their Jaccard similarity, and
the pair varies less than two independent minima would.  Bands of the
signature propose pairs, full shingle sets confirm them, and confirmed links
make components.

Scale.  Documents with equal sets collapse first.  The members of a bucket are
compared with its centre, not with each other, so copies cost one comparison
each; the centre is the member that shares most places in buckets, which is
the one that the others were made from, if it is there.  For two members of
which one or both aren't linked with their centre c, let a document's delta be
what it lacks of c and what it has beyond c.  Then

    |x & y| = |c| - |lacks x| - |lacks y| + |delta x & delta y|,

so a link asks for an overlap of the deltas that is known beforehand and is
never below one.  Elements that one member has alone, or only members already
linked, leave the deltas; those that remain are ordered by how many members
have them, the rarest first.  Members whose prefixes, as long as the overlap
asks for, meet in an element are a bucket of the next round.  Buckets of at
most ``FEW`` members are compared there and then, which costs ``FEW`` / 2
comparisons a member at most; larger ones get a centre of their own, and so on
until no bucket spans two components.  A bucket loses its centre each round,
so the rounds end, and a round costs what the buckets have as members, not
their squares.  This is exact: a pair that shares a bucket is
compared, or is in one component already, or can't reach the threshold.
Buckets and centres are dealt in salted sub-groups, so no task sees the whole
of a hot one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, group_totals, id_out, keyed, release, spread_join, written

#: A pair at similarity 0.85 shares no band with probability (1 - 0.85^4)^24 = 2e-8, at 0.8 with 4e-6.
BANDS, ROWS = 24, 4
#: Members of a bucket that are compared with each other.
FEW = 64
#: Rounds halve what is unresolved and more; so many are none that end.
MOST_ROUNDS = 200
_R = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of the words between ASCII white space, A-Z in lower case, for many texts at once."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of the concatenated texts, and the number of words of each text; ``ends``: of texts in ``data``."""
        n = len(data)
        if len(self.powers) < n + 1:
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _R, np.uint64))])
        gap = self.space[data]
        cut = np.zeros(n + 1, bool)  # a text ends before this byte
        cut[ends] = True
        inside = ~gap
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.lower[data].astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=total[1:])
        # the inverse power shifts a word's hash to the origin: R is odd
        shift = np.uint64(pow(int(_R), -1, 1 << 64))
        inverse = self._inverse(n, shift)
        hashes = (total[end] - total[start]) * inverse[start]
        counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
        return _mix(hashes + (end - start).astype(np.uint64)), counts

    _inv = np.ones(1, np.uint64)

    def _inverse(self, n: int, shift: np.uint64) -> np.ndarray:
        if len(self._inv) < n + 1:
            self._inv = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, shift, np.uint64))])
        return self._inv


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def pieces(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of column ``text``; a longer text is a slice of its own."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(s)
    if at < batch.num_rows:
        yield batch.slice(at)


def shingle_sets(hasher: WordHasher, column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle, none are none."""
    data, ends = buffers(column)
    hashes, counts = hasher(data, ends)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts:
            w = hashes[at : at + n]
            at += n
            if n == 0:
                out.append(w)
                continue
            size = min(k, int(n))
            s = w[: n - size + 1].copy()
            for j in range(1, size):
                s = s * _R + w[j : n - size + 1 + j]
            out.append(np.unique(_mix(s)))
    return out


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the shingles under each multiplier."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(shingles), 1024):
        y = shingles[i : i + 1024] * a[:, None] + b[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate([low, high])


def signer(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        a, b = _constants(bands * rows // 2, seed)
        order = np.random.default_rng(seed + 1).permutation(bands * rows).reshape(bands, rows)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch):
                    sets = shingle_sets(hasher, part.column("text"), k)
                    digests, keys = [], []
                    for s in sets:
                        if not len(s):
                            digests.append(None)
                            keys.append(None)
                            continue
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        v = signature(s, a, b)[order]
                        h = v[:, 0]
                        for j in range(1, rows):
                            h = _mix(h) * _R + v[:, j]
                        keys.append(_mix(h).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("rid"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                        ["rid", "h", "n_shingles", "digest", "bands"],
                    )

    return run


def set_writer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(hasher, part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "shingles"])

    return run


def _compare(num: int, den: int):
    """Rows sorted by (g, cell, first): the centre's set, then those compared with it; yields what each lacks and adds, and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            out = []
            for g, cell, first, c, x, side, label, raw in zip(*(batch.column(n).to_pylist() for n in ("g", "cell", "first", "c", "x", "side", "label")), batch.column("shingles")):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if first == 0:
                    key, centre = (g, cell), s.copy()
                elif key == (g, cell):
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    out.append((g, c, x, side, label, den * both >= num * (len(centre) + len(s) - both), len(centre) - both, len(s) - both, len(s)))
            cols = list(zip(*out)) or [[]] * 9
            kinds = (*[pa.int64()] * 5, pa.bool_(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], ["g", "c", "x", "side", "label", "linked", "lost", "added", "n"])

    return run


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_compare`; yields the elements of each delta."""
    key, centre = None, None
    names = ("g", "x", "side", "label", "apart", "root", "u", "size")
    for batch in batches:
        parts = []
        for g, cell, first, raw, *row in zip(*(batch.column(n).to_pylist() for n in ("g", "cell", "first")), batch.column("shingles"), *(batch.column(n).to_pylist() for n in names)):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            if first == 0:
                key, centre = (g, cell), s.copy()
            elif key == (g, cell):
                parts.append((row, np.setxor1d(s, centre, assume_unique=True).view(np.int64)))
        sizes = [len(p[1]) for p in parts]
        rep = lambda i: pa.array(np.repeat(np.array([p[0][i] for p in parts], np.int64), sizes))
        d = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(d), *(rep(i) for i in range(len(names)))], ["d", *names])


def _beside_centres(pairs: DataFrame, sets: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Sets of ``pairs`` (g, c, x, more) in cells of a group, its centre's own set first in each cell that has members."""
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("x"), F.lit(64)).cast("int"))
    members = dealt.join(sets.withColumnRenamed("rid", "x"), "x").select("g", "cell", F.lit(1).alias("first"), "c", "x", *more, "shingles")
    none = [F.lit(None).cast(dealt.schema[m].dataType).alias(m) for m in more]
    centres = dealt.select("g", "c", "cell").distinct().join(sets.withColumnRenamed("rid", "c"), "c").select("g", "cell", F.lit(0).alias("first"), "c", F.col("c").alias("x"), *none, "shingles")
    return members.unionByName(centres).repartition("g", "cell").sortWithinPartitions("g", "cell", "first")


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """g, c, x, side, label, linked (den * intersection >= num * union), lost, added, n of each of ``pairs`` (g, c, x, side, label)."""
    return _beside_centres(pairs, sets, ("side", "label")).mapInArrow(_compare(num, den), "g long, c long, x long, side long, label long, linked boolean, lost long, added long, n long")


def around_centres(buckets: DataFrame, rooted: bool) -> DataFrame:
    """g, c, x, side, home: the members of ``buckets`` (g, bucket, x, apart, side) beside the centres of their buckets.

    A centre is, of the component with fewest members in the bucket
    (``rooted``: column root names it), the member, one not linked so far if
    there is one, whose buckets have most members, then the one with the
    smallest id.  Buckets of
    one group that share their centre are one group from now on.  The home of
    a member is the best centre that it stands beside, or itself.
    """
    held = group_totals(buckets, ["bucket"], {"_n": F.count("*")}, {"members": F.sum("_n")}, F.col("x"), keep=F.col("members") > 1)
    if rooted:
        held = group_totals(held, ["bucket", "root"], {"_n": F.count("*")}, {"alike": F.sum("_n")}, F.col("x"))
    held = written(held.select("g", "bucket", "x", "apart", "side", "members", (F.col("alike") if rooted else F.lit(0).cast("long")).alias("alike")), "buckets")
    score = held.groupBy("g", "x").agg(F.sum("members").alias("score"))
    rank = F.struct((-F.col("alike")).alias("few"), "apart", "score", (-F.col("x")).alias("o"), F.col("x").alias("c"))
    chosen = group_totals(held.join(score, ["g", "x"]), ["bucket"], {"_c": F.max(rank)}, {"top": F.max("_c")}, F.col("x"))
    pairs = written(chosen.select("g", F.struct("top.score", "top.o", "top.c").alias("top"), "x", "side").distinct(), "pairs")
    home = pairs.groupBy("g", "x").agg(F.max("top").alias("best")).select("g", "x", F.col("best.c").alias("home"))
    out = written(pairs.filter("x <> top.c").join(home, ["g", "x"]).select("g", F.col("top.c").alias("c"), "x", "side", "home"), "pairs")
    discard(held, pairs)
    return out


def within_few(buckets: DataFrame) -> DataFrame:
    """g, c, x, side, label: the pairs that ``buckets`` of FEW members hold and that no other group settles."""
    member = F.struct("x", "side", "label", "root", "apart")
    held = buckets.groupBy("bucket").agg(F.collect_list(member).alias("m"))
    open_ = lambda a, b: (a["side"] != b["side"]) & (a["label"] != b["label"]) & (a["root"] != b["root"]) & (a["apart"] + b["apart"] > 0)
    rest = lambda a, i: F.filter(F.slice("m", i + 2, FEW), lambda b: open_(a, b))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(rest(a, i), lambda b: F.struct(F.least(a["x"], b["x"]).alias("c"), F.greatest(a["x"], b["x"]).alias("x")))))
    none = F.lit(None).cast("long")
    return held.select(F.explode(pairs).alias("p")).select("p.*").distinct().select(F.xxhash64("c").alias("g"), "c", "x", none.alias("side"), none.alias("label"))


def unresolved(tests: DataFrame, sets: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """The next round's buckets (g, bucket, x, side, label, root, apart, members): members that may link though not both do with their centre; ``found``: (node, root) so far.

    With s = num + den, the overlap that deltas need is (u_x + u_y) / 2s for
    u = 2 num n + 2 s lost - s |c|, and no overlap exceeds a delta: y can be a
    partner of x only if u_x is at most v_y = 2 s |delta y| - u_y.  A group's
    least u for each step of v, a few hundred numbers, tells each member the
    least overlap that it needs with any partner, if it has one.  Its prefix
    leaves out one element less than that.
    """
    s = num + den
    rows = tests.withColumn("u", 2 * num * F.col("n") + 2 * s * F.col("lost") - s * (F.col("n") - F.col("added") + F.col("lost")))
    rows = rows.join(found.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    apart = F.min(F.when(~F.col("linked"), F.col("u")))
    totals = {"_n": F.count("*"), "_u": F.min("u"), "_a": apart, "_lo": F.min("root"), "_hi": F.max("root")}
    final = {"members": F.sum("_n"), "least": F.min("_u"), "apart": F.min("_a"), "lo": F.min("_lo"), "hi": F.max("_hi")}
    rows = group_totals(rows, ["g"], totals, final, F.col("x"), keep=(F.col("members") > 1) & F.col("apart").isNotNull() & (F.col("lo") != F.col("hi")))
    least = F.when(F.col("linked"), F.col("apart")).otherwise(F.col("least"))
    rows = rows.filter((F.col("lost") + F.col("added")) * (2 * s) >= F.col("u") + least)
    rows = written(rows.select("g", "c", "x", "side", "label", (~F.col("linked")).cast("long").alias("apart"), "root", "u", (F.col("n") - F.col("added") + F.col("lost")).alias("size")), "around")
    more = ("side", "label", "apart", "root", "u", "size")
    deltas = _beside_centres(rows, sets, more).mapInArrow(_deltas, "d long, g long, x long, " + ", ".join(f"{m} long" for m in more))
    deltas = written(deltas, "deltas")
    discard(rows)
    ends = [(f.__name__, c, f) for f in (F.min, F.max) for c in ("side", "label", "root")]
    partial = {"_n": F.count("*"), "_a": F.max("apart")} | {f"_{n}_{c}": f(c) for n, c, f in ends}
    final = {"members": F.sum("_n"), "any_apart": F.max("_a")} | {f"{n}_{c}": f(f"_{n}_{c}") for n, c, f in ends}
    some = (F.col("members") > 1) & (F.col("any_apart") > 0) & (F.col("min_side") != F.col("max_side")) & (F.col("min_label") != F.col("max_label")) & (F.col("min_root") != F.col("max_root"))
    shared = group_totals(deltas, ["g", "d"], partial, final, F.col("x"), keep=some)
    ordered = F.array_sort(F.collect_list(F.struct("members", "d")))
    kept = written(shared.groupBy("g", "x", *more).agg(ordered.alias("e")), "deltas")
    discard(deltas)
    width = F.greatest(F.floor(F.col("size") * s / 64), F.lit(1))
    step = F.floor((F.size("e") * (2 * s) - F.col("u")) / width)
    bins = kept.groupBy("g", width.alias("width"), step.alias("v")).agg(F.min("u").alias("any"), F.min(F.when(F.col("apart") == 1, F.col("u"))).alias("apart"))
    bins = bins.groupBy("g").agg(F.first("width").alias("width"), F.collect_list(F.struct("v", "any", "apart")).alias("bins"))
    able = F.transform(F.filter("bins", lambda b: (b["v"] + 1) * F.col("width") > F.col("u")), lambda b: F.when(F.col("apart") == 1, b["any"]).otherwise(b["apart"]))
    need = F.greatest(F.ceil((F.col("u") + F.col("least")) / F.lit(2.0 * s)), F.lit(1))
    cut = spread_join(kept, "g", bins, F.col("x")).withColumn("least", F.array_min(able)).filter("least is not null").withColumn("need", need.cast("int")).filter(F.size("e") >= F.col("need"))
    heads = cut.select("g", "x", "side", "label", "apart", "root", F.explode(F.slice("e", F.lit(1), F.size("e") - F.col("need") + 1)).alias("e"))
    heads = heads.select("g", F.xxhash64("g", "e.d").alias("bucket"), "x", "side", "label", "apart", "root")
    out = written(group_totals(heads, ["bucket"], partial, final, F.col("x"), keep=some).select("g", "bucket", "x", "side", "label", "root", "apart", "members"), "unresolved")
    discard(kept)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100,
    bands: int = BANDS, rows: int = ROWS, seed: int = 7,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row. See :func:`near_groups`."""
    found = near_groups(docs, id_col, text_col, k, num, den, bands, rows, seed)
    return found.select(id_out().alias("doc_id"), "n_shingles", id_out("root").alias("component_id"), "kept")


def near_groups(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """rid, h, n_shingles, root, kept; one row per input row.

    Documents are linked when ``den * intersection >= num * union`` of their
    sets of ``k``-word shingles.  Texts without words, null texts included,
    have an empty set, are linked with nothing and stay.  Repeated rows (same
    id and text) get the same component and one is kept.  Rows that share an
    id but not the text are documents of their own.  A null id counts as the
    smallest and comes out null.  An empty table gives an empty result.
    """
    if (bands * rows) % 2:
        raise ValueError("bands * rows must be even: a permutation gives two values")
    texts = keyed(docs, id_col, text_col).select("rid", F.xxhash64("text").alias("h"), "text")
    spark = docs.sparkSession
    signed = texts.mapInArrow(signer(k, bands, rows, seed), "rid long, h long, n_shingles long, digest binary, bands array<long>")
    # a node is a distinct set: documents with equal sets are one from here on
    signed = written(signed.select("rid", "h", "n_shingles", F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).alias("node"), "bands"), "signed")
    full = signed.filter("node is not null")
    reps = full.groupBy("node").agg(F.first(F.struct("rid", "h", "bands")).alias("r")).select("node", "r.*")
    buckets = reps.select(F.lit(0).cast("long").alias("g"), F.posexplode("bands").alias("band", "key"), F.col("node").alias("x")).select("g", F.xxhash64("band", "key").alias("bucket"), "x", F.lit(None).cast("long").alias("side"), F.lit(1).cast("long").alias("apart"))
    pairs = around_centres(buckets, rooted=False)
    involved = reps.select("node", "rid", "h").join(pairs.select(F.explode(F.array("c", "x")).alias("node")).distinct(), "node", "left_semi")
    sets = texts.join(involved, ["rid", "h"]).select(F.col("node").alias("rid"), "text").mapInArrow(set_writer(k), "rid long, shingles binary")
    sets = written(sets, "sets")
    links = spark.createDataFrame([], "u long, v long")
    found = written(spark.createDataFrame([], "node long, root long"), "components")

    pending = False

    def tested(beside: DataFrame) -> DataFrame:
        nonlocal links, pending
        tests = written(compared(beside, sets, num, den), "tests")
        new = tests.filter("linked").select(F.col("c").alias("u"), F.col("x").alias("v"))
        if not new.isEmpty():
            links, pending = written(links.unionByName(new).distinct(), "links"), True
        return tests

    def settle() -> None:
        nonlocal found, pending
        if pending:
            old, found, pending = found, components(links), False
            discard(old)

    # a pair is settled in the group of the home that both have; members of a first round's home are on its side from then on
    label = F.when(F.col("home") == F.col("c"), F.col("x")).otherwise(F.col("home"))
    for _ in range(MOST_ROUNDS):
        if pairs.isEmpty():
            break
        tests = tested(pairs.select(F.xxhash64("g", "c").alias("g"), "c", "x", F.coalesce("side", label).alias("side"), label.alias("label")))
        discard(pairs)
        settle()
        left = unresolved(tests, sets, found, num, den)
        discard(tests)
        close = written(within_few(left.filter(F.col("members") <= FEW)), "pairs")
        if not close.isEmpty():
            discard(tested(close))
        discard(close)
        pairs = around_centres(left.filter(F.col("members") > FEW).select("g", "bucket", "x", "side", "apart", "root"), rooted=True)
        discard(left)
        release(spark)
    else:
        raise RuntimeError("near duplicates did not settle")
    settle()
    discard(pairs, sets)
    least = full.groupBy("node").agg(F.min("rid").alias("least"))
    named = least.join(found, "node", "left").withColumn("top", F.coalesce("root", "node")).drop("root")
    named = group_totals(named, ["top"], {"_r": F.min("least")}, {"root": F.min("_r")}, F.col("node")).select("node", "root")
    linked = spread_join(full.select("rid", "h", "n_shingles", "node"), "node", named, F.col("rid")).drop("node")
    out = linked.unionByName(signed.filter("node is null").select("rid", "h", "n_shingles", F.col("rid").alias("root")))
    nth = F.row_number().over(Window.partitionBy("rid", "h").orderBy("n_shingles"))
    out = out.withColumn("nth", nth)
    return out.select("rid", "h", "n_shingles", "root", ((F.col("rid") == F.col("root")) & (F.col("nth") == 1)).alias("kept"))
