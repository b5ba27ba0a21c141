"""Merge-type subword encoding with seeded merge-dropout, and its exact inverse.

Text becomes pieces of a given vocabulary as in byte-pair encoding: an agenda
holds every adjacent pair that the vocabulary joins; the best pair (highest
score, leftmost) is joined and its neighbours enter the agenda.  With dropout,
a candidate is skipped when a hash keyed by the seed, the row, the word's place
in the row and the candidate's place in the word falls below the rate, so the
same seed gives the same pieces anywhere, and each occurrence its own.

Nothing is normalised.  Spaces become U+2581, one is put in front, and
whatever has no piece, U+2581 of the text itself included, is spelt in byte
pieces; so decoding gives back the very text.

Scale.  A narrow pass: words are cut off at spaces, all of a length are encoded
in step.  Occurrences of a word share their agenda until one skips what
another joins; a long word goes through a heap.  The vocabulary is read on the
driver from ``model_path`` and travels with the function.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_out, keyed
from .minhash import pieces

SPACE = "▁"
#: Spaces and what follows up to the next ones.
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Words up to this many symbols are encoded in step.
STEP_LENGTH = 48
_M = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """Pieces of a merge-type model: what two symbols join to, and how soon."""

    pieces: list[str]
    scores: list[float]
    bytes_at: dict[int, int]
    #: of control and unknown pieces, which no text becomes
    special: frozenset[int]
    chars: dict[str, int] = field(default_factory=dict)
    codes: np.ndarray = None
    joined: np.ndarray = None
    order: np.ndarray = None

    def __post_init__(self) -> None:
        known = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.bytes_at}
        size = len(self.pieces)
        ids = dict(known)
        for p in known:  # letters of a piece that are no piece themselves
            for c in p:
                ids.setdefault(c, size + len(ids) - len(known))
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.width = size + len(ids) - len(known)
        # rank of a joined piece: by score, best first
        rank = {i: r for r, i in enumerate(sorted(known.values(), key=lambda i: (-self.scores[i], i)))}
        pairs = {}
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.codes = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[c] for c in self.codes], np.int64)
        self.order = np.array([rank[i] for i in self.joined], np.int64)
        self.raw = [bytes([self.bytes_at[i]]) if i in self.bytes_at else b"" if i in self.special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.byte_ids = {b: i for i, b in self.bytes_at.items()}

    @classmethod
    def load(cls, model_path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = range(m.vocab_size())
        names = [m.id_to_piece(i) for i in n]
        return cls(names, [m.get_score(i) for i in n], {i: int(names[i][3:5], 16) for i in n if m.is_byte(i)}, frozenset(i for i in n if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))


def _folded(start: np.ndarray | int, *parts: np.ndarray | int) -> np.ndarray:
    h = np.asarray(start).astype(np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * _M
        h = h ^ (h >> np.uint64(32))
    return h


def _last(h: np.ndarray) -> np.ndarray:
    h = h * _M
    return h ^ (h >> np.uint64(29))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int) -> None:
        self.v, self.seed, self.known = vocabulary, seed, {}
        self.limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.table = np.full(0x110000, -1, np.int32)
        self.table[[ord(c) for c in vocabulary.chars]] = list(vocabulary.chars.values())

    def _skipped(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the candidates at these places of occurrences are skipped."""
        if not self.limit:
            return np.zeros(np.shape(keys), bool)
        return _last(_folded(keys, place)) < self.limit

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of pairs; no such piece: the largest rank."""
        code = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.v.width + b)
        at = np.minimum(np.searchsorted(self.v.codes, code), len(self.v.codes) - 1)
        hit = self.v.codes[at] == code
        return np.where(hit, self.v.order[at], np.iinfo(np.int64).max), self.v.joined[at]

    def _pair(self, a: int, b: int) -> tuple[int, int]:
        found = self.known.get((a, b))
        if found is None:
            r, t = self._pairs(np.array([a]), np.array([b]))
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[a, b] = int(r[0]), int(t[0])
        return found

    def in_step(self, symbols: np.ndarray, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Results of occurrences (``row`` of ``symbols`` and key), -1 behind the last piece; the row of each result; the result of each occurrence.

        The agenda of each row takes one step at a time, and a row parts in
        two where some of its occurrences skip the candidate and others do
        not.  A candidate is tried once: skipped, it stays out until a join
        beside it makes a new one.
        """
        n, m = symbols.shape
        s = symbols.astype(np.int32)
        first = np.broadcast_to(np.arange(m, dtype=np.int16), (n, m)).copy()
        last = first.copy()
        none = np.iinfo(np.int64).max
        source, node, of = np.arange(n), row, np.arange(len(row))
        done, sources, result, ended = [], [], np.zeros(len(row), np.int64), 0
        rank, to = self._pairs(s[:, :-1], s[:, 1:]) if m > 1 else (np.full((n, 1), none), np.zeros((n, 1), np.int64))
        while len(s):
            at = rank.argmin(axis=1)
            i = np.arange(len(s))
            live = rank[i, at] < none
            if not live.all():
                over = ~live
                done.append(s[over])
                sources.append(source[over])
                number = np.where(live, np.cumsum(live) - 1, ended + np.cumsum(over) - 1)
                ended += int(over.sum())
                stays = live[node]
                result[of[~stays]] = number[node[~stays]]
                node, of, keys = number[node[stays]], of[stays], keys[stays]
                source, s, first, last, rank, to, at = (x[live] for x in (source, s, first, last, rank, to, at))
                i = np.arange(len(s))
                if not len(s):
                    break
            place = (first[i, at].astype(np.uint64) << np.uint64(32)) | last[i, at + 1].astype(np.uint64)
            code = node * 2 + self._skipped(keys, place[node])
            used = np.zeros(2 * len(s), bool)
            used[code] = True
            node = (np.cumsum(used) - 1)[code]
            used = np.flatnonzero(used)
            out = (used & 1).astype(bool)
            source, s, first, last, rank, to, at = (x[used >> 1] for x in (source, s, first, last, rank, to, at))
            i = np.arange(len(s))
            rank[i[out], at[out]] = none
            i, at = i[~out], at[~out]
            if not len(i):
                continue
            s[i, at], last[i, at] = to[i, at], last[i, at + 1]
            # what stands behind the joined symbol moves up
            take = np.arange(m - 1) + (np.arange(m - 1) > at[:, None])
            for x in (s, first, last):
                x[i, :-1] = np.take_along_axis(x[i], take, axis=1)
                x[i, -1] = -1
            take = np.minimum(np.arange(m - 2) + (np.arange(m - 2) >= at[:, None]), m - 2)
            for x, empty in ((rank, none), (to, 0)):
                x[i, :-1] = np.take_along_axis(x[i], take, axis=1)
                x[i, -1] = empty
            for step in (-1, 0):
                ok = (at + step >= 0) & (at + step + 1 < m)
                j, a = i[ok], at[ok] + step
                rank[j, a], to[j, a] = self._pairs(s[j, a], s[j, a + 1])
        return np.concatenate(done), np.concatenate(sources), result

    def by_heap(self, symbols: list[int], key: int) -> list[int]:
        """The same agenda for one long word: a heap over linked symbols."""
        n = len(symbols)
        s, first, last = list(symbols), list(range(n)), list(range(n))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        none = np.iinfo(np.int64).max
        rank, to = self._pairs(np.array(s[:-1]), np.array(s[1:]))
        agenda = [(int(r), i, i + 1, s[i], s[i + 1], int(t)) for i, (r, t) in enumerate(zip(rank, to)) if r < none]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, a, b, t = heapq.heappop(agenda)
            if s[i] != a or after[i] != j or s[j] != b:
                continue
            if self._skipped(np.uint64(key), np.uint64(first[i] << 32 | last[j])):
                continue
            s[i], last[i], s[j] = t, last[j], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r, t = self._pair(s[x], s[y])
                    if r < none:
                        heapq.heappush(agenda, (r, x, y, s[x], s[y], t))
        out, i = [], 0
        while i >= 0:
            out.append(s[i])
            i = after[i]
        return out

    def words(self, words: list[str], keys: list[int]) -> list[list[int]]:
        """Pieces of each word."""
        flat, begins, lengths, result = self.flat(words, np.arange(len(words)), np.array(keys, np.uint64))
        return [flat[begins[r] : begins[r] + lengths[r]].tolist() for r in result]

    def flat(self, words: list[str], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all results one after the other, where each one's begin and how many they are; the result of each occurrence.

        An occurrence is the number of one of ``words``, which are distinct,
        and a key.  A word's escaped spaces are U+2581; a U+2581 of the text
        comes as U+FFFF.
        """
        if not self.limit:  # nothing is skipped: a word's occurrences are all alike
            back, which = which, np.arange(len(words))
            keys = np.zeros(len(words), np.uint64)
        keys = _folded(self.seed, keys)
        size = len(self.v.pieces)
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        symbols = self.table[points]
        of = np.repeat(np.arange(len(words)), sizes)
        # words with a letter that is no piece are spelt out one by one
        odd = np.zeros(len(words), bool)
        odd[of[(symbols < 0) | (symbols >= size)]] = True
        result = np.zeros(len(which), np.int64)
        parts, lengths, number = [], [], 0
        order = np.argsort(sizes[which], kind="stable")
        distinct, begin = np.unique(sizes[which][order], return_index=True)
        row = np.zeros(len(words), np.int64)
        for m, mine in zip(distinct, np.split(order, begin[1:])):
            if m <= STEP_LENGTH:
                these = np.flatnonzero(sizes == m)
                row[these] = np.arange(len(these))
                done, source, found = self.in_step(symbols[starts[these][:, None] + np.arange(m)], row[which[mine]], keys[mine])
                strange = odd[these[source]]
                # results of ordinary words come first
                back_to = np.where(strange, (~strange).sum() + np.cumsum(strange) - 1, np.cumsum(~strange) - 1)
                result[mine] = number + back_to[found]
                good = done[~strange]
                there = good >= 0
                lengths.append(there.sum(axis=1))
                parts.append(good[there])
                slow = zip(these[source[strange]], done[strange].tolist())
                number += len(good)
            else:
                slow = [(w, self.by_heap(symbols[starts[w] : starts[w] + m].tolist(), int(keys[o]))) for o, w in zip(mine, which[mine])]
                result[mine] = number + np.arange(len(mine))
            for w, r in slow:
                out = self._finished(r, words[w])
                lengths.append(np.array([len(out)]))
                parts.append(np.array(out, np.int32))
                number += 1
        flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        lengths = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        return flat, np.cumsum(lengths) - lengths, lengths, result if self.limit else result[back]

    def _finished(self, row: list[int], word: str) -> list[int]:
        """Without the fill behind the last piece; symbols without a piece in bytes."""
        size, at, out = len(self.v.pieces), 0, []
        for x in row:
            if at >= len(word):
                break
            if 0 <= x < size:
                out.append(x)
                at += len(self.v.pieces[x])
            else:
                c = SPACE if word[at] == "￿" else word[at]
                out += [self.v.byte_ids[b] for b in c.encode("utf-8")]
                at += 1
        return out


def cut(text: str) -> list[str]:
    """Words with the spaces before them escaped; U+2581 of the text comes as U+FFFF, which the text may not hold itself."""
    return WORDS.findall(SPACE + text.replace(SPACE, "\uffff").replace(" ", SPACE))


class Numbers(dict):
    """Numbers words as they are first asked for."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def encode_texts(encoder: Encoder, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """Piece ids of each text; a word's dropout is keyed by the text's key and the word's place."""
    known = Numbers()
    number = known.__getitem__
    rows = []
    for t in texts:
        if not t:
            rows.append([])
        elif "\uffff" in t:  # a noncharacter: its bytes stand between the parts around it
            row = []
            for k, part in enumerate(t.split("\uffff")):
                parts = cut(part) if part or not k else []
                if k:
                    row += [-1 - encoder.v.byte_ids[b] for b in "\uffff".encode()]
                    # the parts behind have no space put in front of them
                    parts = [w for w in [p[1:] if not i else p for i, p in enumerate(parts)] if w]
                row += map(number, parts)
            rows.append(row)
        else:
            rows.append(list(map(number, cut(t))))
    sizes = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    word = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
    at = np.arange(len(word)) - np.repeat(ends - sizes, sizes)
    each = _folded(np.repeat(np.array(keys, np.int64), sizes), 0, at)
    plain = word >= 0
    flat, begins, lengths, found = encoder.flat(known.words, word[plain], each[plain])
    if plain.all():
        result = found
    else:  # single pieces stand behind the words' results
        single = -1 - word[~plain]
        result = np.zeros(len(word), np.int64)
        result[plain], result[~plain] = found, len(lengths) + np.arange(len(single))
        begins = np.concatenate([begins, len(flat) + np.arange(len(single))])
        lengths = np.concatenate([lengths, np.ones(len(single), np.int64)])
        flat = np.concatenate([flat, single.astype(np.int32)])
    n = lengths[result]
    until = np.cumsum(n)
    ids = flat[np.repeat(begins[result] - (until - n), n) + np.arange(n.sum())]
    return np.split(ids, np.concatenate([[0], until])[ends[:-1]])[: len(texts)]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The text's bytes: pieces one after the other, less the space put in front."""
    raw = vocabulary.raw
    return b"".join([raw[i] for i in ids.tolist()])[1:]


def _codec(vocabulary: Vocabulary, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, dropout, seed)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch, 2_000_000):
                    texts = part.column("text").to_pylist()
                    ids = encode_texts(encoder, texts, part.column("key").to_pylist())
                    back = [decode_ids(vocabulary, x) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("rid"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                            pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([b == t.encode() for b, t in zip(back, texts)], pa.bool_()),
                            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                        ],
                        ["rid", "n_pieces", "ids_sha256", "decoded_sha256", "lossless", "ids"],
                    )

    return run


_SCHEMA = "rid long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean, ids array<int>"


def encode_documents(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, lossless, ids; one row per input row.

    Dropout is keyed by id, text and place, so rows of the same text under
    other ids, and a word's occurrences in a row, are each segmented on their
    own.  Null and empty texts have no pieces.  Repeated rows are encoded alike;
    a null id comes out null.
    """
    vocabulary = Vocabulary.load(model_path)
    if len(vocabulary.byte_ids) != 256:
        raise ValueError("the model has no byte pieces: text outside its vocabulary could not be decoded")
    rows = keyed(docs, id_col, text_col).select("rid", "text", F.xxhash64("rid", "text").alias("key"))
    return rows.mapInArrow(_codec(vocabulary, dropout, seed), _SCHEMA).select(id_out().alias("doc_id"), "n_pieces", "ids_sha256", "decoded_sha256", "lossless", "ids")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows of piece ids; a null list is an empty text."""
    vocabulary = Vocabulary.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(vocabulary, np.asarray(x or [], np.int32)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
