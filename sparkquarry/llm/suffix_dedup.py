"""Removal of repeated substrings with suffix arrays per shard.

A byte goes if a string of ``size`` bytes that covers it also starts anywhere
else.  Sorting every suffix of a corpus is out of reach, and no shard need
sort more than the strings that can repeat:

1. Anchors.  Of the ``K``-byte grams in each ``size``-byte string the one with
   the least hash is the string's anchor (leftmost on ties).  Equal strings
   have equal anchors, so a string whose anchor's hash is unique in the corpus
   is unique.  Every start has one anchor, and the starts of an anchor are one
   run: about 1 % of the positions carry the counts.
2. Shards.  For anchors that occur again, the run's text (its starts and
   ``size`` bytes after the last) goes to the shard of the anchor's hash, equal
   texts of a batch once.  A hot anchor is dealt over several shards by text
   and place, so that copies of one text don't meet in one task either.
3. Each shard builds a suffix array by Larsson-Sadakane refinement (ranks by 8
   bytes, then doubling, unsorted groups only, until ``size`` bytes are told
   apart) and common prefixes by Kasai's recurrence over the starts, run in
   lockstep over its texts.  Neighbours that share ``size`` bytes are repeats.
4. Shards of one hot anchor hand on the digest of each distinct string; sorted
   by digest, a string's partners in other shards are found by binary search.
5. Covered runs return to their documents, which are cut.

All of it works on the whole input; nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_totals, id_out, keyed, release, written
from .minhash import buffers

SIZE, K = 400, 128
#: Bytes that are hashed at a time, bytes of a shard, texts of an anchor in one shard.
PIECE, SHARD, LIMIT = 1_000_000, 2_500_000, 4096
#: Bits that number the bytes of a piece: up to PIECE and its last text's rest.
PLACE = 22
#: Bytes of run texts that a batch's dictionary holds before it is handed on.
HELD = 16_000_000
_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams:
    """64-bit polynomial hashes of all grams of a byte array, from prefix sums modulo 2^64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, k: int) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.base, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.inverse, np.uint64))])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        return _mix((total[k:] - total[:-k]) * self.down[: n - k + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours (van Herk): block-wise running minima from both sides."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, grams: Grams, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, first start and last start of every anchor's run in the concatenated texts."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(data, k)
    # the lowest bits make room for places, of any batch alike, so equal strings tie alike
    mask = np.uint64((1 << PLACE) - 1)
    least = _sliding_min((g & ~mask) | np.arange(len(g), dtype=np.uint64), size - k + 1)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    starts = np.flatnonzero(np.arange(len(least)) + size <= end_of[: len(least)])
    at = (least[starts] & mask).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return g[at[first]].view(np.int64), starts[first], starts[last]


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of about PIECE bytes: row, offset in the row's text, bytes, ends. A long text comes in parts that overlap by ``size`` - 1."""
    data, ends = buffers(batch.column("text"))
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    rows, offsets, parts, held = [], [], [], 0

    def out():
        lengths = [len(p) for p in parts]
        return np.array(rows), np.array(offsets), np.concatenate(parts), np.cumsum(lengths)

    for i, (b, e) in enumerate(zip(begins, ends)):
        for c in range(int(b), max(int(e) - size + 1, int(b)), PIECE):
            part = data[c : min(c + PIECE + size - 1, int(e))]
            if held and held + len(part) > PIECE:
                yield out()
                rows, offsets, parts, held = [], [], [], 0
            rows.append(i)
            offsets.append(c - int(b))
            parts.append(part)
            held += len(part)
    if parts:
        yield out()


def _anchor_rows(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(_R1)
        with np.errstate(over="ignore"):
            for batch in batches:
                for rows, _, data, ends in _chunks(batch, size):
                    hashes, lo, _ = anchors(data, ends, grams, size, k)
                    row = rows[np.searchsorted(ends, lo, side="right")]
                    yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row)), batch.column("h").take(pa.array(row)), pa.array(hashes)], ["rid", "h", "anchor"])

    return run


_RUN = "anchor long, n long, win binary, starts int, occ array<struct<rid:long,h:long,at:long>>"


def _run_rows(size: int, k: int):
    """Texts of the runs whose anchor is among the document's repeated ones; equal texts of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(_R1)
        kind = pa.list_(pa.struct([("rid", pa.int64()), ("h", pa.int64()), ("at", pa.int64())]))

        def out(found: dict) -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in keys], pa.int64()), pa.array([found[x][0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.binary()), pa.array([x[2] for x in keys], pa.int32()), pa.array([found[x][1] for x in keys], kind)],
                ["anchor", "n", "win", "starts", "occ"],
            )

        with np.errstate(over="ignore"):
            for batch in batches:
                found: dict = {}
                held = 0
                rid, h = batch.column("rid").to_pylist(), batch.column("h").to_pylist()
                known = batch.column("known")
                sets: dict = {}
                for rows, offsets, data, ends in _chunks(batch, size):
                    hashes, lo, hi = anchors(data, ends, grams, size, k)
                    part = np.searchsorted(ends, lo, side="right")
                    begins = np.concatenate([[0], ends[:-1]])
                    raw = data.tobytes()
                    for p in np.unique(part):
                        row = int(rows[p])
                        if row not in sets:
                            sets = {row: dict(zip(*(known[row].values.field(f).to_pylist() for f in ("anchor", "n"))))}
                        again = sets[row]
                        for x in np.flatnonzero(part == p) if len(ends) == 1 else range(np.searchsorted(part, p), np.searchsorted(part, p, side="right")):
                            n = again.get(int(hashes[x]))
                            if n is None:
                                continue
                            key = (int(hashes[x]), raw[lo[x] : hi[x] + size], int(hi[x] - lo[x] + 1))
                            place = {"rid": rid[row], "h": h[row], "at": int(lo[x] - begins[p] + offsets[p])}
                            if key in found:
                                found[key][1].append(place)
                            else:
                                found[key] = (n, [place])
                                held += len(key[1])
                    if held > HELD:
                        yield out(found)
                        found, held = {}, 0
                if found:
                    yield out(found)

    return run


def suffix_array(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes, and the 8 bytes at each position as a number.

    Larsson-Sadakane: groups of equal 8 bytes are split by the rank 8, 16, 32
    and so on bytes further, until every suffix stands alone, or ``depth``
    bytes are compared; suffixes that agree in those stand in any order.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word |= padded[j : n + j] << np.uint64(8 * (7 - j))
    sa = np.argsort(word)
    new = np.ones(n, bool)
    new[1:] = word[sa[1:]] != word[sa[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head + 1
    h = 8
    while depth is None or h < depth:
        alone = new & np.append(new[1:], True)
        group = np.flatnonzero(~alone)
        if not len(group):
            break
        p = sa[group]
        ahead = p + h
        # behind the end nothing stands, which sorts before any byte, zeros too: the shorter suffix is the smaller
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], np.maximum(n - ahead, -n - 8))
        both = rank[p] * (2 * n + 18) + second + n + 9
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[group] = p
        split = np.ones(len(p), bool)
        split[1:] = both[1:] != both[:-1]
        new[group] = split
        rank[p] = group[np.maximum.accumulate(np.where(split, np.arange(len(p)), 0))] + 1
        h *= 2
    return sa, word


def common_prefixes(n: int, begins: np.ndarray, lengths: np.ndarray, sa: np.ndarray, word: np.ndarray, most: int) -> np.ndarray:
    """Kasai's recurrence: bytes, ``most`` at most, that each position of ``sa`` shares with the one sorted before it.

    ``sa`` holds the first ``lengths`` positions of each text.  From one
    position to the next the common prefix shrinks by one at most, if the
    other position's next one is in ``sa`` too and still sorts before; else it
    is counted anew.  The texts go forward together, one position each step.
    """
    place = np.full(n + 1, len(sa), np.int64)
    place[sa] = np.arange(len(sa))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    longest = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[longest], lengths[longest]
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    shared = np.zeros(len(begins), np.int64)
    other = np.full(len(begins), -1, np.int64)
    for s in range(len(live)):
        m = live[s]
        i = begins[:m] + s
        j = before[i]
        # position -1 + 1 has a place behind none, but then nothing was shared
        l = np.where(place[other[:m] + 1] < place[i], np.maximum(shared[:m] - 1, 0), 0)
        l[j < 0] = 0
        todo = np.flatnonzero((j >= 0) & (l < most))
        while len(todo):
            a, b = i[todo] + l[todo], j[todo] + l[todo]
            ok = (a < n) & (b < n)
            todo, a, b = todo[ok], a[ok], b[ok]
            differ = word[a] ^ word[b]
            same = differ == 0
            # a word's leading zero bytes are the bytes that agree
            top = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1]
            bits = np.where(differ >> np.uint64(11) != 0, top + 11, np.frexp(differ.astype(np.float64))[1])
            l[todo] += np.where(same, 8, (64 - bits) // 8)
            todo = todo[same & (l[todo] < most)]
        # zeros behind the last byte are no bytes
        l = np.minimum(np.minimum(l, n - i), np.where(j >= 0, n - j, 0))
        shared[:m] = np.minimum(l, most)
        other[:m] = j
        out[i] = shared[:m]
    return out


def repeated(wins: list[bytes], starts: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the joined texts: where a start's string repeats, where it is the only one, one place of each repeated string, the texts' begins."""
    lengths = np.array([len(w) for w in wins])
    data = np.frombuffer(b"".join(wins), np.uint8)
    begins = np.cumsum(lengths) - lengths
    sa, word = suffix_array(data, size)
    step = np.arange(len(data)) - np.repeat(begins, lengths)
    weight = np.where(step < np.repeat(starts, lengths), np.repeat(weights, lengths), 0)
    sa = sa[weight[sa] > 0]
    lcp = common_prefixes(len(data), begins, starts, sa, word, size)[sa]
    block = np.cumsum(lcp < size) - 1
    total = np.bincount(block, weights=weight[sa])
    again, only = np.zeros(len(data), bool), np.zeros(len(data), bool)
    many = total[block] >= 2
    again[sa[many]] = True
    only[sa[~many]] = True
    one = sa[many][np.unique(block[many], return_index=True)[1]]
    return again, only, one, begins


def _shard(size: int):
    """Rows sorted by (anchor, sub) in; covered runs, and digests of a split anchor's strings, out."""
    names = ["rid", "h", "first", "last", "d1", "d2"]

    def table(rid, h, first, last, d1, d2) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid, h, first, last, d1, d2)], names)

    def work(rows: list, hash1: Grams, hash2: Grams) -> Iterator[pa.RecordBatch]:
        # equal texts of one anchor, from several batches, are sorted once
        alike: dict = {}
        for win, starts, occ, split in rows:
            alike.setdefault((win, starts, split), []).extend(occ)
        rows = [(win, starts, occ, split) for (win, starts, split), occ in alike.items()]
        wins, occ = [r[0] for r in rows], [r[2] for r in rows]
        again, only, one, begins = repeated(wins, np.array([r[1] for r in rows]), np.array([len(o) for o in occ]), size)
        edge = np.diff(again.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        text = np.searchsorted(begins, first, side="right") - 1
        found = [(o["rid"], o["h"], o["at"] + int(f - begins[t]), o["at"] + int(l - begins[t]) + size) for f, l, t in zip(first, last, text) for o in occ[t]]
        if found:
            a, b, c, d = zip(*found)
            yield table(a, b, c, d, [None] * len(a), [None] * len(a))
        split = np.array([r[3] for r in rows])
        if split.any():
            data = np.frombuffer(b"".join(wins), np.uint8)
            x, y = hash1(data, size).view(np.int64), hash2(data, size).view(np.int64)
            alone = np.flatnonzero(only)
            t = np.searchsorted(begins, alone, side="right") - 1
            alone, t = alone[split[t]], t[split[t]]
            rid, h, at = (np.array([o[0][f] for o in occ], np.int64) for f in ("rid", "h", "at"))
            yield table(rid[t], h[t], at[t] + alone - begins[t], at[t] + alone - begins[t] + size, x[alone], y[alone])
            one = one[split[np.searchsorted(begins, one, side="right") - 1]]
            none = [None] * len(one)
            yield table(none, none, none, none, x[one], y[one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash1, hash2 = Grams(_R1), Grams(_R2)
        rows, held, key, last = [], 0, None, None
        with np.errstate(over="ignore"):
            for batch in batches:
                for anchor, sub, subs, win, starts, occ in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sub", "subs", "win", "starts", "occ"))):
                    if held > SHARD and (anchor, sub) != key:
                        yield from work(rows, hash1, hash2)
                        rows, held = [], 0
                    key = (anchor, sub)
                    rows.append((win, starts, occ, subs > 1))
                    held += len(win) if win != last else 0
                    last = win
            if rows:
                yield from work(rows, hash1, hash2)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests sorted by (d1, d2): each comes from another shard, so a start is covered if binary search finds its digest twice."""
    held = None
    kind = np.dtype([("d1", np.int64), ("d2", np.int64)])

    def out(t: pa.Table) -> pa.RecordBatch:
        d = np.empty(t.num_rows, kind)
        d["d1"], d["d2"] = t["d1"].to_numpy(), t["d2"].to_numpy()
        open_ = np.flatnonzero(~t["rid"].is_null().to_numpy())
        twice = np.searchsorted(d, d[open_], side="right") - np.searchsorted(d, d[open_], side="left") > 1
        return t.take(pa.array(open_[twice])).select(["rid", "h", "first", "last"]).combine_chunks()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        d1, d2 = t["d1"].to_numpy(), t["d2"].to_numpy()
        end = int(np.flatnonzero((d1 == d1[-1]) & (d2 == d2[-1]))[0])
        held = t.slice(end)
        if end:
            yield from out(t.slice(0, end)).to_batches()
    if held is not None:
        yield from out(held).to_batches()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their covered runs."""
    for batch in batches:
        texts, runs = batch.column("text").cast(pa.large_binary()), batch.column("runs")
        size, removed, spans, sums, left = [], [], [], [], []
        for i in range(batch.num_rows):
            raw = texts[i].as_py()
            kept, at, n, gone = [], 0, 0, 0
            if runs[i].is_valid:
                v = runs[i].values
                last = -1
                for f, l in sorted(zip(v.field("first").to_pylist(), v.field("last").to_pylist())):
                    if f > last:
                        n += 1
                        kept.append(raw[at:f])
                        at, last = f, f
                    if l > last:
                        gone += l - max(last, f)
                        at = last = l
            kept.append(raw[at:])
            rest = b"".join(kept)
            size.append(len(raw))
            removed.append(gone)
            spans.append(n)
            sums.append(hashlib.sha256(rest).hexdigest())
            left.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.binary())], ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes; one row per input row.

    Texts are UTF-8 bytes; a null one is empty.  Texts shorter than ``size``
    keep every byte.  Repeated rows (same id and text) repeat each other, so
    they lose what ``size`` covers, as any copies do.  A null id comes out
    null.  An empty table gives an empty result.
    """
    texts = keyed(docs, id_col, text_col)
    # rows that agree in id and text are one row with a count, so that each place is met once
    texts = texts.select("rid", F.xxhash64("text").alias("h"), "text")
    found = texts.mapInArrow(_anchor_rows(size, gram), "rid long, h long, anchor long")
    again = group_totals(found, ["anchor"], {"_n": F.count("*")}, {"n": F.sum("_n")}, F.col("rid"), keep=F.col("n") > 1)
    known = again.groupBy("rid", "h").agg(F.collect_set(F.struct("anchor", "n")).alias("known"))
    # by sorting, so that a task that is run again meets its rows in the same order: the shard of a hot
    # anchor's places follows from the batch they came in
    runs = texts.hint("merge").join(known.hint("merge"), ["rid", "h"]).mapInArrow(_run_rows(size, gram), _RUN)
    subs = F.ceil(F.col("n") / LIMIT).cast("int")
    dealt = runs.withColumn("subs", subs).withColumn("sub", F.pmod(F.xxhash64("win", F.get("occ", F.lit(0))["rid"]), F.col("subs")).cast("int"))
    shards = dealt.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "win")
    out = written(shards.mapInArrow(_shard(size), "rid long, h long, first long, last long, d1 long, d2 long"), "shards")
    release(docs.sparkSession)  # the texts are shuffled once more below
    within = out.filter("d1 is null").select("rid", "h", "first", "last")
    digests = out.filter("d1 is not null").repartition("d1", "d2").sortWithinPartitions("d1", "d2")
    across = digests.mapInArrow(_merged, "rid long, h long, first long, last long")
    covered = within.unionByName(across).groupBy("rid", "h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    both = texts.hint("shuffle_hash").join(covered.hint("shuffle_hash"), ["rid", "h"], "left").select("rid", "text", "runs")
    cut = both.mapInArrow(_cut, "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return cut.select(id_out().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
