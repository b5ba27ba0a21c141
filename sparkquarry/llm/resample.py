"""Importance resampling toward a target distribution (Xie et al., 2023) with an exact top-k by histogram.

Hashed counts of word n-grams of the corpus and of the target give each bucket
a gain; a document's weight is the sum of its features' gains, and its score
the weight plus Gumbel noise keyed by the id, so the highest scores are a draw
without replacement in proportion to the weights.

The draw sorts nothing as a whole.  Scores are integers: a histogram of
distinct scores, cut into bins by approximate quantiles (which decide how even
the bins are, never a result), is summed from the top, bin by bin and then
inside a bin.  The sums give the cutoff score and the rank at which each
score begins; rows are numbered by id inside their score.  A score with many
rows is cut into cells of ids first, so no task has to number them all.

Scale.  Texts are read twice, in narrow passes; a task sends one row for each
bucket.  Only rows at or above the cutoff are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_out, keyed, written
from .minhash import buffers, pieces

#: Bytes of text that are worked on at once.
SLICE = 8_000_000
#: Distinct scores in a bin, rows in a cell of one score.
SCORES_PER_BIN, ROWS_PER_CELL = 50_000, 20_000


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a checksum becomes when n zero bytes follow it, as xor of a value for each of its four bytes: for n below 256, and for n = 256 * 2^k."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of one byte: linear in its bits

    def after_zero(c: np.ndarray) -> np.ndarray:
        return (c >> np.uint32(8)) ^ one[c & np.uint32(255)]

    low = np.empty((256, 4, 256), np.uint32)
    low[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 256):
        low[n] = after_zero(low[n - 1])
    high = np.empty((23, 4, 256), np.uint32)
    high[0] = after_zero(low[255])
    for k in range(1, 23):
        high[k] = _apply(high[k - 1], high[k - 1])
    return low, high


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


class FeatureHasher:
    """Buckets of all runs of 1 to ``orders`` words of many texts, by the crc32 of their UTF-8 bytes.

    The checksum of a run follows from those of its parts, so each distinct
    word of a slice is hashed once and longer runs are never put together.
    """

    def __init__(self, buckets: int, orders: int = 3) -> None:
        self.buckets, self.orders = buckets, orders
        self.low, self.high = _shift_tables()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.word = np.zeros(256, bool)
        self.word[48:58] = self.word[65:91] = self.word[97:123] = True
        self.word[128:] = True

    def joined(self, a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Checksums of concatenations, from those of both parts and the sizes of the second."""
        small = size_b & 255
        out = self.low[small, 0, a & 255]
        for k, by in ((1, 8), (2, 16), (3, 24)):
            out ^= self.low[small, k, (a >> by) & 255]
        rest, k = size_b >> 8, 0
        while rest.any():
            odd = np.flatnonzero(rest & 1)
            out[odd] = _apply(self.high[k], out[odd])
            rest, k = rest >> 1, k + 1
        return out ^ b

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket) of every feature in arrays, and the number of words of each text."""
        data, ends = buffers(column)
        inside = self.word[data]
        cut = np.zeros(len(data) + 1, bool)  # a text ends before this byte
        cut[ends] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        start = np.flatnonzero(begins)
        n_words = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
        letters = self.lower[data[inside]]
        place = np.flatnonzero(begins[inside])  # where each word begins among the letters
        size = np.diff(np.concatenate([place, [len(letters)]]))
        offsets = np.concatenate([place, [len(letters)]]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        code = words.indices.to_numpy(zero_copy_only=False)
        plain = np.fromiter((zlib.crc32(w) for w in distinct), np.uint32, len(distinct))[code]
        spaced = np.fromiter((zlib.crc32(w + b" ") for w in distinct), np.uint32, len(distinct))[code]
        text = np.repeat(np.arange(len(n_words)), n_words)
        rows, found = [text], [plain % np.uint32(self.buckets)]
        run, length = plain, size  # the run that begins at each word, and its bytes
        for n in range(2, self.orders + 1):
            run, length = self.joined(spaced[: len(run) - 1], run[1:], length[1:]), size[: len(run) - 1] + 1 + length[1:]
            whole = text[: len(run)] == text[n - 1 :]
            rows.append(text[: len(run)][whole])
            found.append(run[whole] % np.uint32(self.buckets))
        return np.concatenate(rows), np.concatenate(found).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: features of all ``texts`` (column ``text``); a task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = FeatureHasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, SLICE):
                total += np.bincount(hasher(part.column("text"))[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from bucket counts: a row for each bucket comes to the driver."""
    n = np.zeros((2, buckets), np.int64)
    both = corpus.withColumn("k", F.lit(0)).unionByName(target.withColumn("k", F.lit(1)))
    for r in both.collect():
        n[r["k"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = n, n.sum(axis=1)
    ratio = ((t + 1.0) * (all_s + float(buckets))) / ((s + 1.0) * (all_t + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(seed: int, ids: list[int | None]) -> np.ndarray:
    """Gumbel noise in thousandths, keyed by seed and id; a null id is an empty string."""
    h = np.array([int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids], float)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def scored(texts: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """rid, n_words, n_features, weight, score of ``keyed`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = FeatureHasher(len(gain))
        for batch in batches:
            for part in pieces(batch, SLICE):
                text, bucket, n_words = hasher(part.column("text"))
                # a text's features don't lie together; sums of integers are exact whatever their order
                weight = np.zeros(len(n_words), np.int64)
                np.add.at(weight, text, gain[bucket])
                rid = part.column("rid")
                score = weight + noise(seed, [None if i == NULL_ID else i for i in rid.to_pylist()])
                yield pa.RecordBatch.from_arrays([rid, *(pa.array(x, pa.int64()) for x in (n_words, np.bincount(text, minlength=len(n_words)), weight, score))], ["rid", "n_words", "n_features", "weight", "score"])

    return texts.mapInArrow(run, "rid long, n_words long, n_features long, weight long, score long")


def _bin(score: Column, splits: list[int]) -> Column:
    """How many of the ascending ``splits`` lie at or below ``score``."""

    @F.pandas_udf("long")
    def find(s):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(splits, np.int64), s.to_numpy(np.int64), side="right"))

    return find(score)


def from_the_top(histogram: DataFrame, order: list[Column], per_bin: int = SCORES_PER_BIN) -> DataFrame:
    """``histogram`` (score, n and more) with ``before``: the rows in front of each row in ``order``, which begins with the highest score."""
    distinct = histogram.agg(F.count("*")).first()[0]
    bins = min(10_000, -(-distinct // per_bin))
    splits = []
    if bins > 1:
        splits = sorted(set(histogram.agg(F.percentile_approx("score", [i / bins for i in range(1, bins)], 20_000)).first()[0]))
    found = histogram.withColumn("bin", _bin(F.col("score"), splits) if splits else F.lit(0).cast("long"))
    # one row for each bin: at most 10,000
    total = found.groupBy("bin").agg(F.sum("n").alias("all"))
    total = total.select("bin", (F.sum("all").over(Window.orderBy(F.desc("bin"))) - F.col("all")).alias("above"))
    inside = F.sum("n").over(Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("upto", inside).join(F.broadcast(total), "bin").withColumn("before", F.col("above") + F.col("upto") - F.col("n")).drop("bin", "above", "upto")


def ranked(rows: DataFrame, k: int, per_bin: int = SCORES_PER_BIN, per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``rows`` (score, rid, ...; a written table) with ``rank``: 1 to ``k`` for the highest scores, ties to smaller ids, null for the rest.

    Rows alike in score and id are numbered by their other columns.
    """
    none = F.lit(None).cast("long")
    histogram = rows.groupBy("score").agg(F.count("*").alias("n"), F.min("rid").alias("least"), F.max("rid").alias("most"))
    histogram = written(from_the_top(histogram, [F.desc("score")], per_bin), "histogram")
    above = written(histogram.filter(F.col("before") < k), "above")  # scores from the cutoff up
    cutoff = above.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", none)
    # many rows of one score: cells of equal width over its ids, in order, each with its own offset
    n_cells = F.ceil(F.col("n") / per_cell)
    # (as doubles: ids may be further apart than a long can say)
    at = (F.col("rid").cast("double") - F.col("least").cast("double")) / (F.col("most").cast("double") - F.col("least").cast("double") + 1)
    cell = F.when(n_cells == 1, 0).otherwise(F.least(F.floor(at * n_cells), n_cells - 1)).cast("long")
    placed = rows.filter(F.col("score") >= cutoff).join(above, "score").withColumn("cell", cell).drop("least", "most", "n")
    cells = placed.groupBy("score", "cell").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("score").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("score", "cell", earlier.alias("earlier"))
    others = [c for c in rows.columns if c not in ("score", "rid")]
    nth = F.row_number().over(Window.partitionBy("score", "cell").orderBy("rid", *others))
    rank = F.col("before") + F.col("earlier") + F.col("nth")
    found = placed.withColumn("nth", nth).join(cells, ["score", "cell"]).select(*rows.columns, F.when(rank <= k, rank).cast("long").alias("rank"))
    return found.unionByName(rows.filter(F.col("score") < cutoff).withColumn("rank", none))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", per_bin: int = SCORES_PER_BIN, per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank; one row per input row, the undrawn ones with a null rank.

    Of the N rows with ``least_words`` words, floor(percent * N / 100) are
    drawn.  Null and empty texts have no words, weight 0 and their noise as
    score.  A null id is keyed as an empty string and ranks before other ids
    of its score.  Repeated rows are rows of their own and share a score;
    they take successive ranks.  Empty tables give empty results; an empty
    target makes rare words weigh more than frequent ones.
    """
    rows = keyed(docs, id_col, text_col)
    aim = keyed(target.select(F.lit(0).alias("doc_id"), target[f"`{target_text}`"].alias("text")))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets), buckets)
    found = written(scored(rows, gain, seed), "scored")
    fit = F.col("n_words") >= least_words
    k = found.filter(fit).count() * percent // 100
    out = ranked(found.filter(fit), k, per_bin, per_cell).unionByName(found.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select(id_out().alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")
