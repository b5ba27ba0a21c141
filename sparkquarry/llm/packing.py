"""Mixture-controlled packing of documents into token sequences, by deficit round-robin (Shreedhar and Varghese, 1995).

Each source is a queue of the tokens of its documents.  A round gives every
queue that isn't empty a quantum, its target's share of a window; a queue sends
whole packets of ``grain`` tokens while its credit lasts and carries the rest.
The rounds' tokens, one after the other, are cut every ``size`` tokens, so each
window is full and holds the sources in their target proportions, but for a
packet and the fraction that is carried.  What is left behind the last full window is
cut into powers of two, which need no padding.

No round is played.  What a queue has sent after r rounds has a closed form,
``min(tokens, grain * floor((r * quantum + credit) / grain))``, hence its deficit too,
and every task can continue the schedule wherever its documents begin: a
document needs the tokens that lie before it in its queue, which follow from
running sums inside a task and from the tasks' totals, and the totals of all
queues, which are few.

Scale.  Texts are read once, ids written once as 16-bit numbers where the
vocabulary allows, and never shuffled.  Sources beyond ``max_queues`` share queues by
a hash of their name.  The tokens of a distinct word are found once for each slice of a task's texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, col, id_out, written
from .decontaminate import small
from .minhash import buffers, pieces

SIZE, GRAIN, MAX_QUEUES = 4096, 64, 256
#: Bytes of text, tokens and new words that are worked on at once; words that a task remembers.
SLICE, TOKENS, WORDS_AT_ONCE, KNOWN = 4_000_000, 2_000_000, 5_000, 250_000


@dataclass(frozen=True)
class TokenizerParts:
    """What tasks need of a tokenizer's file, taken out of it once."""

    json: str
    special: tuple[str, ...]
    #: numpy type that holds all ids
    kind: str
    #: the bare model for words of ASCII letters, whether they are put in lower case, and which ids end a word; or nothing
    bare: str | None = None
    lower: bool = False
    ends: np.ndarray | None = None

    @staticmethod
    def of(tokenizer_json: str, last: int | None) -> TokenizerParts:
        found = json.loads(tokenizer_json)
        model, added = found["model"], found["added_tokens"]
        most = max([*model["vocab"].values(), *[t["id"] for t in added], last or 0])
        parts = [tokenizer_json, tuple(t["content"] for t in added), "<u2" if most < 1 << 16 else "<u4"]
        if not model.get("end_of_word_suffix"):
            return TokenizerParts(*parts)
        if "ByteLevel" not in json.dumps(found["pre_tokenizer"]):
            return TokenizerParts(*parts)
        # a word of letters is one token to the splitter, and the suffix of its last piece tells where it ends
        ends = np.zeros(most + 1, bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
        bare = json.dumps(found | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})
        return TokenizerParts(*parts, bare, '"Lowercase"' in json.dumps(found["normalizer"]), ends)


#: Letters that are composed already, have one lower-case letter below U+0180, and no other form: Latin, without the dotted capital I.
LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on; a space stays."""
    own = np.arange(256, dtype="<u2")
    others = np.array([b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)])
    own[others] = 256 + np.arange(len(others))
    own[32] = 32
    return own


class WordTokens:
    """Token ids of many texts, by the tokenizers library, each distinct word encoded once.

    Fits tokenizers that split at white space and drop it, and between a
    Latin letter and an ASCII sign or digit behind it, keep letters
    together and normalise at most to composed lower case.  Texts that hold a
    special token are encoded whole.
    """

    def __init__(self, parts: TokenizerParts, last: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.parts, self.tokenizer = parts, Tokenizer.from_str(parts.json)
        self.bare = Tokenizer.from_str(parts.bare) if parts.bare else None
        self.last = np.array([] if last is None else [last], np.int32)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.letter = np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self.sign = ~self.letter & ~self.space
        self.sign[128:] = False
        # the second byte of U+00C0 to U+00FF, the signs among them left out
        self.second = np.zeros(256, bool)
        self.second[128:192] = True
        self.second[[0x97, 0xB7]] = False
        self.bytes = byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words, numbered as they come."""
        plain, others = [], []
        for w in words:
            (plain if self.bare and (w.isalpha() or LATIN.fullmatch(w.decode())) else others).append(w)
        flat, sizes = [self.flat], [np.diff(self.starts)]
        for i in range(0, len(plain), WORDS_AT_ONCE):
            text = b" ".join(plain[i : i + WORDS_AT_ONCE]).decode()
            raw = np.frombuffer((text.lower() if self.parts.lower else text).encode(), np.uint8)
            text = self.bytes[raw].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode(text, add_special_tokens=False).ids, np.int32)
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.parts.ends[ids]), prepend=-1))
        for i in range(0, len(others), WORDS_AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in others[i : i + WORDS_AT_ONCE]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1].sum())))
        self.number.update(zip(chain(plain, others), range(len(self.number), len(self.number) + len(words))))
        self.flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        if len(sizes) != len(self.number) or self.starts[-1] != len(self.flat):
            raise ValueError("the tokenizer does not keep the letters of a word together")

    def _split(self, column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, the word at each place, and how many each text has."""
        data, ends = buffers(column)
        inside = ~self.space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        begins = inside.copy()
        letter = self.letter[data]  # the last byte of a letter
        letter[1:] |= self.second[data[1:]] & (data[:-1] == 0xC3)
        begins[1:] &= ~inside[:-1] | cut[1:-1] | (self.sign[data[1:]] & letter[:-1])
        place = np.flatnonzero(begins[inside])
        counts = np.diff(np.searchsorted(np.flatnonzero(begins), np.concatenate([[0], ends])))
        offsets = np.concatenate([place, [int(inside.sum())]]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
        return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text, closed by ``last``."""
        odd = np.zeros(len(column), bool)
        for mark in self.parts.special:
            odd |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        whole = {int(i): np.array(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(odd)}
        words, code, counts = self._split(pc.if_else(pa.array(odd), pa.scalar("", column.type), column) if whole else column)
        if len(self.number) > KNOWN:
            self._forget()
        if new := [w for w in words if w not in self.number]:
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, length = self.starts[at][code], (self.starts[at + 1] - self.starts[at])[code]
        until = np.cumsum(length)
        index = np.repeat(first - (until - length), length)
        index += np.arange(len(index))
        ids = self.flat[index]
        ends = np.concatenate([[0], until])[np.cumsum(counts)]
        parts = np.split(ids, ends[:-1]) if len(counts) else []
        return [np.concatenate([whole.get(i, x), self.last]) for i, x in enumerate(parts)]


def tokenised(texts: DataFrame, parts: TokenizerParts, last: int | None) -> DataFrame:
    """rid, queue, task, at, n, ids: of rows (rid, queue, text) the ids as little-endian numbers, and the tokens before the row in its queue in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokens, sent = TaskContext.get().partitionId(), WordTokens(parts, last), {}
        for batch in batches:
            for part in pieces(batch, SLICE):
                ids = tokens(part.column("text"))
                at = []
                for q, x in zip(part.column("queue").to_pylist(), ids):
                    at.append(sent.get(q, 0))
                    sent[q] = at[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("queue"), pa.array([task] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(parts.kind).tobytes() for x in ids], pa.binary())],
                    ["rid", "queue", "task", "at", "n", "ids"],
                )

    return texts.mapInArrow(run, "rid long, queue int, task int, at long, n long, ids binary")


@dataclass(frozen=True)
class Schedule:
    """Deficit round-robin over queues that hold ``tokens``, with ``quantum / 2 ** bits`` tokens a round, in packets of ``grain``.

    Queues begin with different parts of a packet as credit: else queues with
    like shares would all send one packet more in the same round, and rounds
    would differ in length from windows.
    """

    tokens: np.ndarray
    quantum: np.ndarray
    bits: int
    grain: int
    size: int

    @staticmethod
    def of(tokens: list[int], shares: list[float], size: int = SIZE, grain: int = GRAIN) -> Schedule:
        """The quanta nearest to the shares; as fine as sums of all rounds in 64 bits allow."""
        for bits in range(24, -1, -1):
            quantum = [max(1, round(s * size * 2**bits)) for s in shares]
            rounds = max([-(-(t + grain) * 2**bits // k) + 1 for t, k in zip(tokens, quantum)], default=1)
            if max(rounds * max(quantum, default=1), (max(tokens, default=0) + 2 * grain) * 2**bits) < 2**62:
                break
        return Schedule(np.array(tokens, np.int64), np.array(quantum, np.int64), bits, grain, size)

    def credit(self) -> np.ndarray:
        """What each queue begins with."""
        n = len(self.tokens)
        return np.array([(2 * q + 1) * (self.grain << self.bits) // (2 * n) for q in range(n)], np.int64)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has sent after so many rounds."""
        credit = rounds[..., None] * self.quantum + self.credit()
        return np.minimum(self.tokens, credit // (self.grain << self.bits) * self.grain)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round, from 1, in which a queue's token (from 0) is sent."""
        packet = token // self.grain + 1
        need = packet * (self.grain << self.bits) - self.credit()[queue]
        return -(-need // self.quantum[queue])

    def begins(self, queue: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (queue, round): the queue's tokens sent before and after it, and how many tokens of all queues come before it."""
        out = [np.empty(len(queue), np.int64) for _ in range(3)]
        step = max(1, 1_000_000 // max(1, len(self.tokens)))
        for i in range(0, len(queue), step):
            q, r = queue[i : i + step], rounds[i : i + step]
            before, after = self.sent(r - 1), self.sent(r)
            row, earlier = np.arange(len(q)), np.arange(len(self.tokens)) < q[:, None]
            out[0][i : i + step], out[1][i : i + step] = before[row, q], after[row, q]
            out[2][i : i + step] = np.where(earlier, after, before).sum(axis=1)
        return tuple(out)

    def ends(self) -> np.ndarray:
        """Where the windows behind the last full one end: powers of two, the largest first."""
        total = int(self.tokens.sum())
        at, found = total - total % self.size, []
        for k in range(self.size.bit_length(), -1, -1):
            if (total % self.size) >> k & 1:
                at += 1 << k
                found.append(at)
        return np.array(found, np.int64)

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start, length, window and offset of each piece of documents that lie at ``first`` in their queues."""
        low, high = self.round_of(queue, first), self.round_of(queue, first + n - 1)
        doc, rounds = _expanded(low, high)
        sent, upto, place = self.begins(queue[doc], rounds)
        begin, end = np.maximum(first[doc], sent), np.minimum((first + n)[doc], upto)
        some = end > begin
        doc, begin, end, place = doc[some], begin[some], end[some], (place + begin - sent)[some]
        # cut where windows end
        tail = self.ends()
        full = int(self.tokens.sum()) // self.size

        def window(at: np.ndarray) -> np.ndarray:
            return np.where(at < full * self.size, at // self.size, full + np.searchsorted(tail, at, side="right"))

        bounds = np.concatenate([[full * self.size], tail])
        piece, number = _expanded(window(place), window(place + (end - begin) - 1))
        starts_at = np.where(number <= full, number * self.size, bounds[np.maximum(number - full, 0)])
        ends_at = np.where(number < full, (number + 1) * self.size, bounds[np.minimum(np.maximum(number - full, 0) + 1, len(bounds) - 1)])
        p0, p1 = np.maximum(place[piece], starts_at), np.minimum((place + end - begin)[piece], ends_at)
        start = (begin - first[doc])[piece] + p0 - place[piece]
        doc, length, offset = doc[piece], p1 - p0, p0 - starts_at
        # rounds that follow each other in a window are one piece
        joins = np.zeros(len(doc), bool)
        joins[1:] = (doc[1:] == doc[:-1]) & (number[1:] == number[:-1]) & (offset[1:] == offset[:-1] + length[:-1])
        keep = np.flatnonzero(~joins)
        length = np.add.reduceat(length, keep) if len(keep) else length
        return doc[keep], start[keep], length, number[keep], offset[keep]


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value from ``low`` to ``high`` of each row."""
    n = high - low + 1
    row = np.repeat(np.arange(len(low)), n)
    return row, low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]


def _cut(schedule: Schedule, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = np.flatnonzero(np.diff(np.cumsum(n) // TOKENS, append=-1)) + 1  # slices of about so many tokens
            for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
                part = batch.slice(int(lo), int(hi - lo))
                queue, first, size = (part.column(c).to_numpy().astype(np.int64) for c in ("queue", "first", "n"))
                doc, start, length, window, offset = schedule.pieces(queue, first, size)
                ids = [np.frombuffer(x, kind).astype("<u4") for x in part.column("ids").to_pylist()]
                crc = [zlib.crc32(ids[d][a : a + k]) for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist())]
                columns = [start, length, np.array(crc, np.int64), size[doc], window, offset]
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns)], ["rid", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def _queues(docs: DataFrame, source: Column, targets: dict[str, float] | None, most: int) -> tuple[Column, list[list[str | None]]]:
    """The queue of a row, and the sources that ``targets`` may name, by queue."""
    named = docs.select(source.alias("s")).distinct().limit(most + 1).collect()
    if len(named) <= most:
        names = sorted((r["s"] for r in named), key=lambda x: (x is not None, x or ""))
        known = [x for x in names if x is not None]
        at = F.array_position(F.array(*[F.lit(x) for x in known]).cast("array<string>"), source).cast("int") - 1 + int(None in names)
        return F.when(source.isNull(), 0).otherwise(at), [[x] for x in names]
    # sources with a target keep a queue of their own
    own = sorted(targets or {})
    if len(own) >= most:
        raise ValueError(f"targets name more than {most - 1} sources")
    rest = F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(most - len(own))).cast("int") + len(own)
    at = F.array_position(F.array(*[F.lit(x) for x in own]).cast("array<string>"), F.coalesce(source, F.lit(""))).cast("int")
    return F.when(source.isNotNull() & (at > 0), at - 1).otherwise(rest), [[x] for x in own] + [[] for _ in range(most - len(own))]


def mixed_shares(tokens: list[int], names: list[list[str | None]], targets: dict[str, float] | None) -> list[float]:
    """Each queue's share of a window: its target, or what targets leave in proportion to tokens."""
    total = [(targets or {}).get(x[0]) if len(x) == 1 and x[0] is not None else None for x in names]
    left = max(0.0, 1.0 - sum(t for t in total if t is not None))
    free = sum(n for n, t in zip(tokens, total) if t is None)
    found = [left * n / free if t is None and free else t or 0.0 for n, t in zip(tokens, total)]
    return [x / sum(found) for x in found] if sum(found) else [1.0] * len(found)


def pack_mixture(
    docs: DataFrame, tokenizer_json: str, size: int = SIZE, last: int | None = 2, targets: dict[str, float] | None = None, grain: int = GRAIN,
    max_queues: int = MAX_QUEUES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece of a document.

    ``targets`` gives sources their share of every window; the others divide
    what is left by their tokens.  Without targets each source's share is that
    of its tokens, so the mixture holds from the first window to the last;
    with targets it holds while the sources last, and an empty queue is passed
    over.  A queue follows the order of tasks and of rows in them.

    ``size`` is a power of two.  A document is closed by the id ``last``, so
    null and empty texts are one token; without ``last`` they have no piece.
    Null sources are a queue of their own (beyond ``max_queues``, they share
    one), a table without a source column is one queue, a null id comes out
    null, repeated rows are packed each.  An empty table gives an empty
    result.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    source = col(docs, source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    queue, names = _queues(docs, source, targets, max_queues)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), queue.alias("queue"))
    rows = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), "queue", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = TokenizerParts.of(tokenizer_json, last)
    tokens = written(tokenised(rows, parts, last), "tokens")
    # a row for each task and queue
    sums = written(tokens.groupBy("queue", "task").agg(F.sum("n").alias("n")), "sums")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # max_queues rows at most
    held = [int(total.get(q, 0)) for q in range(len(names))]
    schedule = Schedule.of(held, mixed_shares(held, names, targets), size, grain)
    offsets = written(sums.select("queue", "task", earlier.alias("earlier")), "offsets")
    found = tokens.filter("n > 0").join(small(offsets), ["queue", "task"]).select("rid", "queue", (F.col("earlier") + F.col("at")).alias("first"), "n", "ids")
    out = found.mapInArrow(_cut(schedule, parts.kind), "rid long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(id_out().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
