"""Toxicity scores by a linear classifier over character n-grams scaled by naive Bayes ratios (Wang and Manning, 2012).

A feature is the presence of a hashed byte n-gram in the lower-cased text,
scaled by the log of how much more often it occurs in toxic than in other
documents; logistic regression is fitted on the scaled features, both classes
with the same weight in all, as toxic documents are few.

Bounds.  The fit takes ``max_train`` labelled rows at most, chosen by a hash
of the id, and keeps the ``max_features`` n-grams that tell the classes apart
best; the model is ``max_features`` numbers, and the driver holds one number
for each feature that occurs in a row, at most 40 million.  The bound on
features isn't there for speed: with ten times as many the held-out rows are
told apart worse (README).  Scoring is one narrow pass over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, col, keyed, written
from .minhash import buffers, pieces

ORDERS = (3, 4, 5, 6)
BITS = 20
MAX_TRAIN, MAX_FEATURES = 20_000, 2_000


class GramBuckets:
    """Buckets of all n-grams of concatenated texts; A-Z count as a-z, line ends and tabs as spaces."""

    def __init__(self, bits: int) -> None:
        self.bits = np.uint64(64 - bits)
        self.map = np.arange(256, dtype=np.uint8)
        self.map[65:91] += 32
        self.map[9:14] = 32

    def __call__(self, data: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
        """For each order, the bucket of the gram at every byte that has one."""
        x = self.map[data].astype(np.uint64) + np.uint64(1)
        code = np.zeros(len(x), np.uint64)
        for n in range(1, max(orders) + 1):
            if n > len(x):
                return
            code = code[: len(x) - n + 1] * np.uint64(257) + x[n - 1 :]
            if n in orders:
                yield n, (((code ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)


def present(grams: GramBuckets, column: pa.Array, known: np.ndarray | None, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, of the buckets in the mask ``known`` if given."""
    data, ends = buffers(column)
    found = []
    for n, bucket in grams(data, orders):
        at = np.flatnonzero(known[bucket]) if known is not None else np.arange(len(bucket))
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[text]
        found.append(text[inside].astype(np.int64) << 32 | bucket[at[inside]])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> 32, both & 0xFFFFFFFF


def _counts(bits: int, orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = GramBuckets(bits), np.zeros((2, 1 << bits), np.int32)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch, 1_000_000):
                    text, bucket = present(grams, part.column("text"), None, orders)
                    label = part.column("label").to_numpy(zero_copy_only=False)[text]
                    for y in (0, 1):
                        n[y] += np.bincount(bucket[label == y], minlength=1 << bits).astype(np.int32)
        some = np.flatnonzero(n.any(axis=0))
        for i in range(0, len(some), 100_000):
            s = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n[0][s].astype(np.int64)), pa.array(n[1][s].astype(np.int64))], ["bucket", "clean", "toxic"])

    return run


def _design(bits: int, orders: tuple[int, ...], known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, mask = GramBuckets(bits), np.zeros(1 << bits, bool)
        mask[known] = True
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch, 1_000_000):
                    text, bucket = present(grams, part.column("text"), mask, orders)
                    ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                    column = np.searchsorted(known, bucket)
                    yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(column.astype(np.int32)))], ["label", "features"])

    return run


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    orders: tuple[int, ...]
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of ridge logistic regression over sparse rows, the classes balanced; Nesterov steps under a bound of the curvature."""
    v, n, m = scale[columns], len(y), len(scale)
    each = np.where(y == 1, max(1.0, (1 - y).sum() / max(y.sum(), 1)), max(1.0, y.sum() / max((1 - y).sum(), 1)))
    w, b, pw, pb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    rate = 1.0 / (0.25 * each.max() * (_norm(rows, columns, v, n, m) + n) + l2)
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        qw, qb = w + (t - 1) / t2 * (w - pw), b + (t - 1) / t2 * (b - pb)
        err = (1 / (1 + np.exp(-np.clip(np.bincount(rows, v * qw[columns], n) + qb, -30, 30))) - y) * each
        pw, pb, t = w, b, t2
        w = qw - rate * (np.bincount(columns, v * err[rows], m) + l2 * qw)
        b = qb - rate * err.sum()
    return w * scale, float(b)


def _norm(rows: np.ndarray, columns: np.ndarray, v: np.ndarray, n: int, m: int) -> float:
    """The largest eigenvalue of X'X, by power iteration."""
    x = np.ones(m)
    size = 0.0
    for _ in range(15):
        x = np.bincount(columns, v * np.bincount(rows, v * x[columns], n)[rows], m)
        size = float(np.linalg.norm(x))
        if not size:
            break
        x /= size
    return size * 1.1


def held_out(id_: Column) -> Column:
    """Rows that no label may be learnt from; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    bits: int = BITS, orders: tuple[int, ...] = ORDERS, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES,
) -> ToxicityModel:
    """Fits on labelled rows that aren't held out, ``max_train`` of them at most.

    Null labels and null ids teach nothing; of several labels of an id the
    largest counts.  Without rows of both classes the model is a constant.
    """
    marked = labels.select(col(labels, id_col).cast("long").alias("rid"), col(labels, label_col).cast("int").alias("label")).dropna()
    marked = marked.filter(~held_out(F.col("rid"))).groupBy("rid").agg(F.max("label").alias("label"))
    chosen = marked.orderBy(F.xxhash64("rid"), "rid").limit(max_train)
    texts = keyed(docs, id_col, text_col).filter(F.col("rid") != NULL_ID)
    sample = written(texts.join(F.broadcast(chosen), "rid").select("rid", "text", F.least("label", F.lit(1)).alias("label")), "toxicity")
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 1)
        return ToxicityModel(bits, orders, np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))) if clean + toxic else -3.0)
    counts = sample.select("text", "label").mapInArrow(_counts(bits, orders), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # how far the toxic count lies from what independence gives, in its own deviations
    n = clean + toxic
    expected = (F.col("clean") + F.col("toxic")) * (toxic / n)
    surprise = F.pow(F.col("toxic") - expected, 2) / (expected * (clean / n) * (1.0000001 - (F.col("clean") + F.col("toxic")) / n))
    best = counts.filter(f"clean + toxic >= {max(2, n // 2000)}").orderBy(surprise.desc(), "bucket").limit(max_features).toPandas().sort_values("bucket")
    if best.empty:
        return ToxicityModel(bits, orders, np.zeros(0, np.int64), np.zeros(0), float(np.log(toxic / clean)))
    known = best["bucket"].to_numpy(np.int64)
    p, q = best["toxic"].to_numpy() + 1.0, best["clean"].to_numpy() + 1.0
    ratio = np.log((p / (toxic + 2)) / (q / (clean + 2)))
    table = sample.select("text", "label").mapInArrow(_design(bits, orders, known), "label int, features array<int>").toPandas()
    lengths = table["features"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(table)), lengths)
    columns = np.concatenate(table["features"].to_list()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    weights, bias = logistic(rows, columns, ratio, table["label"].to_numpy(float))
    return ToxicityModel(bits, orders, known, weights, bias)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Column of scores from 0 to 1; a null text counts as an empty one, whose score is the bias alone."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = GramBuckets(model.bits)
        weight = np.zeros(1 << model.bits, np.float64)
        weight[model.buckets] = model.weights
        known = np.zeros(1 << model.bits, bool)
        known[model.buckets] = True
        with np.errstate(over="ignore"):
            for s in parts:
                batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(s, type=pa.large_string())], ["text"])
                out = []
                for part in pieces(batch, 1_000_000):
                    rows, bucket = present(grams, part.column("text"), known, model.orders)
                    out.append(1 / (1 + np.exp(-np.clip(np.bincount(rows, weight[bucket], part.num_rows) + model.bias, -500, 500))))
                yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row, repeated rows scored alike, null ids kept, none held out."""
    model = model or train_toxicity(docs, labels, id_col, text_col, label_col)
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
