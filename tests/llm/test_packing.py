"""Mixture-controlled packing: ids beside the library's, the schedule beside a round-robin that is played, every id in one piece."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkquarry.llm import packing
from sparkquarry.llm.queries import op13_mixture_packing

JSON = open(public_tokenizers.path("word_bpe_49k.json")).read()
LIBRARY = Tokenizer.from_str(JSON)
SF = "/root/testdata/sf0.01"
ODD = ["", " ", "Don't  STOP, e.g. 3.14 x2y", "<|endoftext|> a<|startoftext|>b c", "İstanbul ΣΑΣ ΣΑΣ.", "e ́x é é,́", "a\x1cb\u0085c d　e", "\x00 ￿ 😀😀 a‍b", "it's ,'s 's a's,'ll'd9", "日本語 тест 가각", "w " * 3000, "x" * 5000, "<| not a mark |>", "\n\t\r\x0b\x0c ", "KÅK ﬁ"]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids():
    tokens = packing.WordTokens(packing.TokenizerParts.of(JSON, 2), 2)
    for texts in (ODD, ODD[::-1], [""], []):
        assert [x.tolist() for x in tokens(pa.array(texts, pa.string()))] == [library(t) for t in texts]


def test_ids_of_every_latin_letter():
    """Each letter of the range, in both cases and beside signs, as the library has it."""
    words = [chr(c) for c in range(0x20, 0x250)]
    texts = [" ".join(f + w + e for w in words) for f in ("", "a", "é", ",", "'", "1") for e in ("", "S", "ß,", ".x", "'s", "2")]
    tokens = packing.WordTokens(packing.TokenizerParts.of(JSON, 2), 2)
    assert [x.tolist() for x in tokens(pa.array(texts))] == [library(t) for t in texts]


def test_ids_of_a_whole_table(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in packing.WordTokens(packing.TokenizerParts.of(JSON, 2), 2)(pa.array(texts))] == [library(t) for t in texts]


def played(tokens, quantum, bits, grain, credit):
    """(queue, tokens) in the order in which deficit round-robin sends them."""
    left, credit, sent = list(tokens), [int(c) for c in credit], []
    while any(left):
        for q in range(len(tokens)):
            credit[q] += int(quantum[q])
            packets = credit[q] // (grain << bits)
            credit[q] -= packets * (grain << bits)
            now = min(left[q], packets * grain)
            left[q] -= now
            if now:
                sent.append((q, now))
    return sent


@pytest.mark.parametrize("tokens,shares,size,grain", [([1000, 300, 20], [0.7, 0.25, 0.05], 64, 8), ([50, 500, 3, 1], [0.25] * 4, 32, 4), ([777], [1.0], 16, 64), ([0, 90, 90], [0.5, 0.3, 0.2], 64, 1)])
def test_schedule(tokens, shares, size, grain):
    s = packing.Schedule.of(tokens, shares, size, grain)
    at, want = 0, defaultdict(list)  # place of every token of each queue
    for q, n in played(tokens, s.quantum, s.bits, grain, s.credit()):
        want[q] += range(at, at + n)
        at += n
    total = sum(tokens)
    ends = [*range(size, total + 1, size), *s.ends()]
    assert all((b - a) & (b - a - 1) == 0 for a, b in zip([0, *ends], ends)) and ends[-1] == total
    rng = np.random.default_rng(1)
    for q, n in enumerate(tokens):
        if not n:
            continue
        cuts = sorted({0, n, *rng.integers(0, n + 1, 9).tolist()})
        first, size_of = np.array(cuts[:-1]), np.diff(cuts)
        doc, start, length, window, offset = s.pieces(np.full(len(first), q), first, size_of)
        got = []
        for d, a, k, w, o in zip(doc, start, length, window, offset):
            begin = ([0, *ends][w]) + o
            assert begin + k <= ends[w]
            got += [(first[d] + a + i, begin + i) for i in range(k)]
        assert got == list(enumerate(want[q]))


def check(rows, docs, size):
    """Every id in one piece, sequences gapless and of full length or a power of two; returns windows' tokens by document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for i, ids in docs.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    lengths = []
    for k in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[k], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        lengths.append(at)
        assert at <= size and (at == size or at & (at - 1) == 0)
    return lengths, by_sequence


def test_whole_table(spark):
    docs = {r["doc_id"]: (r["source"], library(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_mixture_packing(spark, SF).collect()
    lengths, windows = check(rows, {i: ids for i, (_, ids) in docs.items()}, 4096)
    total = sum(len(ids) for _, ids in docs.values())
    assert lengths[: total // 4096] == [4096] * (total // 4096)
    # every full window holds each source as the whole does, but for packets and the queue that is cut at both ends
    share, off = defaultdict(float), []
    for source, ids in docs.values():
        share[source] += len(ids) / total
    for k in range(total // 4096):
        found = defaultdict(int)
        for r in windows[k]:
            found[docs[r["doc_id"]][0]] += r["length"]
        off += [abs(found[source] - s * 4096) for source, s in share.items()]
    print(max(off), np.mean(off))
    assert max(off) <= 4 * packing.GRAIN and np.mean(off) <= packing.GRAIN


def test_targets(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i} " * (30 if i % 2 else 90), "ab"[i % 2] if i % 10 else None) for i in range(200)], "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    docs = {r["doc_id"]: library(r["text"]) for r in df.collect()}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    rows = packing.pack_mixture(df, JSON, size=256, targets={"a": 0.25, "b": 0.5}, grain=8).collect()
    _, windows = check(rows, docs, 256)
    held = lambda k: {s: sum(r["length"] for r in windows[k] if source[r["doc_id"]] == s) for s in ("a", "b", None)}
    for k in range(20):
        assert abs(held(k)["a"] - 64) <= 16 and abs(held(k)["b"] - 128) <= 16 and abs(held(k)[None] - 64) <= 16
    many = packing.pack_mixture(df, JSON, size=256, max_queues=2, grain=8).collect()
    check(many, docs, 256)


def test_edges(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s"), (4, "lorem ipsum " * 20_000, "t"), (None, "x", None), (5, "\x00 <|endoftext|>", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("rid", "queue", "task", "at", "n", "ids", "first", "earlier")})
    got = packing.pack_mixture(df, JSON).collect()
    assert sum(r["length"] for r in got) == sum(len(library(t)) for _, t, _ in rows)
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * len(library("a b c")) and {r["doc_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert [r["length"] for r in got if r["doc_id"] is None] == [2]
    assert packing.pack_mixture(df.filter("false"), JSON).collect() == []
    assert len(packing.pack_mixture(df.drop("source"), JSON).collect()) >= len(rows)
    none = packing.pack_mixture(df.filter("text is null or text = ''"), JSON, last=None)
    assert none.collect() == []
    with pytest.raises(ValueError):
        packing.pack_mixture(df, JSON, size=100)
