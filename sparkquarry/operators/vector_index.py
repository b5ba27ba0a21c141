"""Vector search by an inverted file: each vector lies in the cell of its nearest centre.

Centres are fitted on a bounded sample; every row is assigned.  A search may
look into the nearest cells alone (approximate), or go on until no other cell
can hold a better match (exact).  For unit vectors the cosine and the distance
d tell the same, cos = 1 - d^2 / 2, and a match within r of x lies in cell j
only if x is within r of the plane between its own centre and j's, and within
r plus the cell's radius of j's centre.  What can't be ruled out so is
multiplied as matrices, part by part, in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as VX
from ..sources.shared import shared_path, stored

#: Rows that centres are fitted on at most, and centres at most.
SAMPLE, MOST_CENTRES = 20_000, 1024
#: Rows of a part whose pairs are sought, of a slice that is searched and of a block of queries, at most or so; slices at least, if there are rows enough.
PART, SLICE, BLOCK, SLICES = 8192, 65536, 16384, 32
#: What rounding may hide in a distance.
SLACK = 1e-5


def fit_centres(rows: DataFrame, key: str, vector: str, k: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centres by k-means over a sample of ``sample`` rows at most, chosen by a hash of their keys; ``k`` is the root of the rows if not given."""
    n = rows.count()
    if k is None:
        k = min(MOST_CENTRES, max(1, int(n**0.5)))
    h = F.xxhash64(key, F.lit(seed))
    chosen = rows.filter(F.col(vector).isNotNull()).select(h.alias("h"), F.col(key).alias("k"), F.col(vector).alias("v"))
    if n > sample:  # by a bound of the hash: a sort with a limit would bring so many rows of each task to the driver
        chosen = chosen.filter(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * 0.97 * sample / n))
    found = chosen.toArrow().sort_by([("h", "ascending"), ("k", "ascending")]).slice(0, sample).column("v").combine_chunks()
    if not len(found):
        return np.zeros((0, 0))
    x = np.asarray(found.flatten().to_numpy(zero_copy_only=False), float).reshape(len(found), -1)
    x = x[(x * x).sum(axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(x), 1024)] or [np.zeros(0, int)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = vectors / np.where(size > 0, size, 1)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added from the first place to the last as :func:`vectors.dot` does, so that both give the same doubles."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _dots(x, y) / (np.sqrt(_dots(x, x)) * np.sqrt(_dots(y, y)))


@dataclass
class Index:
    """``rows`` (the columns of the table, ``_cell``, ``_d``: the distance to its centre) without vectors of no length, and each cell's radius."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    vector: str


def build(rows: DataFrame, key: str, vector: str, centres: np.ndarray | None = None) -> Index:
    """Assigns every row; the index is a written table in the shared folder."""
    centres = fit_centres(rows, key, vector) if centres is None else centres

    @F.pandas_udf("cell int, d double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(v), centres)
        own = d.argmin(axis=1)
        return pd.DataFrame({"cell": own, "d": d[np.arange(len(d)), own]})

    path = shared_path(rows.sparkSession, "vectors")
    found = rows.filter(F.col(vector).isNotNull() & (VX.norm(F.col(vector)) > 0)).withColumn("_n", nearest(vector))
    found.withColumns({"_cell": F.col("_n.cell"), "_d": F.col("_n.d")}).drop("_n").write.parquet(path)
    found = rows.sparkSession.read.parquet(path)
    radius = np.zeros(len(centres))
    for r in found.groupBy("_cell").agg(F.max("_d").alias("d")).collect():  # a row for each centre
        radius[r["_cell"]] = r["d"]
    return Index(found, centres, radius, vector)


def _visits(centres: np.ndarray, radius: np.ndarray, x: np.ndarray, reach: np.ndarray, nearest: int | None = None) -> np.ndarray:
    """Rows by cells: whether a cell can hold a vector within ``reach`` of a row; if it is one of the ``nearest`` few, if given."""
    d = _distances(x, centres)
    if nearest is not None:
        visits = np.zeros(d.shape, bool)
        np.put_along_axis(visits, np.argsort(d, axis=1, kind="stable")[:, :nearest], True, axis=1)
        return visits
    own = d.argmin(axis=1)
    at = np.arange(len(d))
    between = np.sqrt(np.maximum(2 - 2 * centres[own] @ centres.T, 1e-18))
    plane = (d**2 - d[at, own][:, None] ** 2) / (2 * between)
    plane[at, own] = 0
    return (plane <= reach[:, None] + SLACK) & (d <= reach[:, None] + radius + SLACK)


def _runs(cells: np.ndarray) -> list[tuple[int, int, int]]:
    """(cell, from, to) of sorted ``cells``."""
    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
    return [(int(cells[lo]), lo, hi) for lo, hi in zip(cuts, cuts[1:])] if len(cells) else []


def _agreeing(rows: DataFrame, same: list[str]) -> DataFrame:
    """Rows without null in ``same``: null agrees with nothing."""
    for c in same:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def _largest(rows: DataFrame, same: list[str]) -> tuple[int, int]:
    """How many groups ``same`` makes, and the rows of the largest."""
    r = rows.groupBy(*same).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    return r["groups"], r["most"] or 0


def _dealt(key: str, into: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(into)).cast("int")


def pairs_within(index: Index, key: str, least: float, same: list[str] = ()) -> DataFrame:
    """a, b, similarity of all pairs (a < b) that agree in ``same`` and have a cosine of ``least`` (above 0) or more. Exact.

    Rows alike in ``same`` and vector meet once, as the one with the smallest
    key, and their pairs are put out at the end: as many rows as the answer has.
    Rows are dealt to parts of ``PART`` or so; each two parts are a group,
    whose cells are multiplied as matrices if they can hold rows near enough.
    What a product proposes is computed as Spark would.
    """
    v, same = index.vector, list(same)
    alike = [*same, v]
    centres, reach = index.centres, float(np.sqrt(2 - 2 * least))
    path = shared_path(index.rows.sparkSession, "vectors")
    index.rows.groupBy(*alike, "_cell", "_d").agg(F.min(key).alias("_first")).write.parquet(path)
    first = index.rows.sparkSession.read.parquet(path)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "id"])
        left, right = rows[rows["part"] == rows["lo"]], rows[rows["part"] == rows["hi"]]
        x, y = _matrix(left["v"]), _matrix(right["v"])
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        ids, ids_ = left["id"].to_numpy(), right["id"].to_numpy()
        cells, dy, dx = right["cell"].to_numpy(), right["d"].to_numpy(), left["d"].to_numpy()
        far = np.zeros(len(centres))
        np.maximum.at(far, cells, dy)
        a, b, c = [], [], []
        for cell, lo, hi in _runs(left["cell"].to_numpy()):
            apart = np.sqrt(np.maximum(2 - 2 * centres @ centres[cell], 0))
            some = np.flatnonzero((apart <= dx[lo:hi].max() + far + reach + SLACK)[cells])
            for i in range(lo, hi, 1024):
                j = min(i + 1024, hi)
                at, to = np.nonzero(u[i:j] @ w[some].T >= least - 1e-9)
                at, to = at + i, some[to]
                if left["lo"].iat[0] == left["hi"].iat[0]:
                    once = ids[at] < ids_[to]
                    at, to = at[once], to[once]
                s = _cosines(x[at], y[to])
                good = s >= least
                a.append(ids[at[good]])
                b.append(ids_[to[good]])
                c.append(s[good])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "similarity": np.concatenate(c)})

    parts = max(1, -(-_largest(first, same)[1] // PART))
    rows = _agreeing(first, same).select(*same, F.col("_first").alias("id"), F.col(v).alias("v"), F.col("_cell").alias("cell"), F.col("_d").alias("d"), _dealt("_first", parts).alias("part"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other")
    kind = dict(first.dtypes)["_first"]
    found = rows.groupBy(*same, "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}, similarity double")
    # back to all rows: copies of a vector are members of its first row
    member = index.rows.select(*alike, F.col(key).alias("_key")).join(first.select(*alike, "_first"), alike).select("_first", "_key")
    across = found.join(member.select(F.col("_first").alias("a"), F.col("_key").alias("ka")), "a").join(member.select(F.col("_first").alias("b"), F.col("_key").alias("kb")), "b")
    across = across.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    inside = member.select("_first", F.col("_key").alias("a")).join(member.select("_first", F.col("_key").alias("b")), "_first").filter("a < b")
    itself = first.select("_first", VX.cosine(F.col(v), F.col(v)).alias("similarity"))
    return across.unionByName(inside.join(itself, "_first").select("a", "b", "similarity").filter(F.col("similarity") >= least))


def top_matches(index: Index, queries: DataFrame, key: str, k: int, same: list[str] = (), probes: int = 8, exact: bool = True, places: int = 6) -> DataFrame:
    """query_id, match_id, score, rank: the ``k`` rows with the highest cosine (rounded to ``places``; ties to smaller keys), the query itself apart.

    ``queries`` has the index's columns.  The ``probes`` nearest cells give
    ``k`` candidates; in exact mode the worst of them, or nothing if there
    are fewer, bounds how far a better one can be, and all cells within that
    reach are searched.  Members are dealt to slices, queries go to each of
    them in blocks; a block and a slice multiply cell by cell as matrices, so
    no pair of vectors is a row, and put out the few that can be among the
    best, with cosines as Spark would compute them.
    """
    v, same = index.vector, list(same)
    centres, radius, margin = index.centres, index.radius, 10.0**-places + 1e-9
    groups, most = _largest(index.rows, same)
    slices = max(1, min(-(-most // 1024), max(-(-SLICES // max(groups, 1)), -(-most // SLICE))))
    members = _agreeing(index.rows, same).select(*same, F.col("_cell").alias("cell"), F.col(key).alias("match_id"), F.col(v).alias("y"), _dealt(key, slices).alias("slice"))
    asked = _agreeing(queries, same).filter(F.col(v).isNotNull() & (VX.norm(F.col(v)) > 0)).select(*same, F.col(key).alias("query_id"), F.col(v).alias("x"))
    blocks = max(1, -(-_largest(asked, same)[1] // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    members = members.withColumn("block", every(blocks))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    kind = dict(index.rows.dtypes)[key]

    def searched(rows: DataFrame, nearest: int | None) -> DataFrame:
        def search(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(m):
                m = m.sort_values(["cell", "match_id"])
                y, ids = _matrix(m["y"]), m["match_id"].to_numpy()
                w, runs = y / np.linalg.norm(y, axis=1, keepdims=True), _runs(m["cell"].to_numpy())
                step = max(1, min(512, 8_000_000 // len(m)))
                for i in range(0, len(q), step):
                    part = q.iloc[i : i + step]
                    x, own = _matrix(part["x"]), part["query_id"].to_numpy()
                    u = x / np.linalg.norm(x, axis=1, keepdims=True)
                    visits = _visits(centres, radius, x, part["reach"].to_numpy(float), nearest)
                    s = np.full((len(x), len(y)), -np.inf)
                    whole = visits[:, [c for c, _, _ in runs]].mean() > 0.3
                    if whole:  # one product, and what isn't visited is taken out
                        s = np.where(visits[:, m["cell"].to_numpy()], u @ w.T, -np.inf)
                    for c, lo, hi in [] if whole else runs:
                        some = np.flatnonzero(visits[:, c])
                        if len(some):
                            s[some, lo:hi] = u[some] @ w[lo:hi].T
                    s[own[:, None] == ids[None, :]] = -np.inf
                    bound = np.partition(s, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(x), -np.inf)
                    at, to = np.nonzero((s >= bound[:, None] - margin) & (s > -np.inf))
                    c = _cosines(x[at], y[to])
                    # of equal cosines, copies mostly, the first k can be among the best
                    order = np.lexsort((ids[to], -c, at))
                    at, to, c = at[order], to[order], c[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (np.diff(at) != 0) | (np.diff(c) != 0)
                    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                    good = np.arange(len(at)) - start < k
                    out.append(pd.DataFrame({"query_id": own[at[good]], "match_id": ids[to[good]], "cosine": c[good]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "match_id": [], "cosine": []})

        keys = [*same, "slice", "block"]
        rows = rows.withColumns({"block": _dealt("query_id", blocks), "slice": every(slices)})
        found = rows.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(search, f"query_id {kind}, match_id {kind}, cosine double")
        found = found.select("query_id", "match_id", F.round("cosine", places).alias("score"))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = searched(asked.withColumn("reach", F.lit(0.0)), probes)
    if not exact:
        return stored(near, "matches")
    worst = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * (F.col("worst") - 10.0**-places), F.lit(0.0)))).otherwise(2.0)
    more = asked.join(stored(worst, "matches"), "query_id", "left").withColumn("reach", F.coalesce(reach, F.lit(2.0)))
    return searched(more, None)


def probes_for(index: Index, key: str, k: int, same: list[str] = (), least: float = 0.95, sample: int = 200, seed: int = 7) -> int:
    """How many cells an approximate search must look into so that ``least`` of the true matches of ``sample`` rows lie in them.

    The sample (the first rows by a hash of their keys) is searched exactly; a
    match asks for as many cells as are nearer than its own.
    """
    asked = index.rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).drop("_cell", "_d")
    true = top_matches(index, asked, key, k, same).select("query_id", "match_id")
    centres = index.centres

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(_distances(_matrix(v), centres), axis=1, kind="stable")))

    order = asked.select(F.col(key).alias("query_id"), nearest(index.vector).alias("cells"))
    cell = index.rows.select(F.col(key).alias("match_id"), "_cell")
    place = true.join(cell, "match_id").join(order, "query_id").select(F.array_position("cells", F.col("_cell")).alias("at"))
    found = place.agg(F.percentile("at", least)).first()[0]
    return int(np.ceil(found)) if found else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """recall: the share of exact (query_id, match_id) that were found."""
    hit = exact.join(found.select("query_id", "match_id", F.lit(1).alias("hit")), ["query_id", "match_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
