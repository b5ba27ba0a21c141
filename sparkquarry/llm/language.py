"""Language identification by Bayesian fusion of evidence.

Four sources are added as log probabilities: the text's byte 3-grams under a
multinomial model per language, the language that the markup declares, and the
prior of the row's host.  Host priors come from grouped counts of what the
texts alone say, smoothed towards their address suffix and that towards the
whole table.  A row's own vote is taken out of its host's counts.  A text must
also fit the language found: what none of the languages wrote is rejected, however
much likelier one of them is than the others.

Scale.  The model is languages x 2^16 counts, summed over every training row
by grouped aggregation; text scoring is one narrow pass; priors reach rows by
salted joins, so a host with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, group_totals, id_out, keyed, written
from .minhash import buffers, pieces

BITS, ORDER = 16, 3
#: Bytes of text that are worked on at once.
SLICE = 1_000_000
#: Grams of text evidence at most: beyond it more text says no more, as grams aren't independent.
WEIGHT = 60.0
#: Mean log likelihood of a gram may lie so far below that of the language's own grams.
FIT = 5.0
#: Rows of the wider group that a host's, or a suffix's, counts are mixed with.
HOST_PULL, SUFFIX_PULL = 20.0, 50.0
#: Languages a model can hold, so that what is collected stays bounded.
MAX_LANGUAGES = 256


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram at each byte, and whether it holds a letter; ASCII that is no letter counts as a space."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
    x = table[data]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), code != 0x202020


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, the text of each, and the bytes of each text; grams across texts, or without a letter, are left out."""
    data, ends = buffers(column)
    size = np.diff(ends, prepend=0)
    if len(data) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), size
    text = np.repeat(np.arange(len(ends)), size)
    bucket, letter = _grams(data)
    inside = np.flatnonzero((text[: len(data) - 2] == text[2:]) & letter)
    return bucket[inside], text[inside], size


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, SLICE):
            bucket, text, _ = _split(part.column("text"))
            lang = part.column("lang").dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)[text]
            for i, name in enumerate(lang.dictionary.to_pylist()):
                found[name] = found.get(name, 0) + np.bincount(bucket[code == i], minlength=1 << BITS)
    for name, n in found.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some].astype(np.int64))], ["lang", "bucket", "n"])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: languages x buckets
    log_p: np.ndarray
    #: mean log likelihood of each language's own grams
    own: np.ndarray


def train_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> LanguageModel:
    """Counts over every row with a language; null languages and texts teach nothing."""
    rows = docs if where is None else docs.filter(where)
    rows = rows.select(col(rows, text_col).cast("string").alias("text"), F.lower(F.substring_index(col(rows, lang_col).cast("string"), "-", 1)).alias("lang")).dropna()
    table = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = written(table, "grams")
    names = [r["lang"] for r in table.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are declared")
    names = sorted(names)
    pdf = table.toPandas()
    n = np.zeros((len(names), 1 << BITS))
    at = {x: i for i, x in enumerate(names)}
    np.add.at(n, (pdf["lang"].map(at).to_numpy(np.int64), pdf["bucket"].to_numpy(np.int64)), pdf["n"].to_numpy(float))
    alpha = 0.1
    log_p = np.log((n + alpha) / (n.sum(axis=1, keepdims=True) + alpha * n.shape[1]))
    return LanguageModel(tuple(names), log_p.astype(np.float32), (n * log_p).sum(axis=1) / np.maximum(n.sum(axis=1), 1))


def text_evidence(rows: DataFrame, model: LanguageModel, weight: float = WEIGHT) -> DataFrame:
    """``rows`` with, in place of ``text``, grams, log (a likelihood for each language, the best is 0; no grams: all 0) and fit (each one's mean of a gram less the language's own)."""
    size, others = len(model.languages), [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.log_p.T)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.ravel(), pa.float64()))
        for batch in batches:
            for part in pieces(batch, SLICE):
                bucket, row, _ = _split(part.column("text"))
                n = np.bincount(row, minlength=part.num_rows)
                total = np.stack([np.bincount(row, table[:, j][bucket], part.num_rows) for j in range(size)], axis=1).astype(float) if size else np.zeros((part.num_rows, 0))
                fit = total / np.maximum(n, 1)[:, None] - model.own
                total *= (np.minimum(n, weight) / np.maximum(n, 1))[:, None]
                log = total - total.max(axis=1, keepdims=True) if size else total
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.array(n, pa.int64()), lists(log), lists(fit)], [*(f.name for f in others), "grams", "log", "fit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{kinds}, grams long, log array<double>, fit array<double>")


def evidence_key(host: Column, suffix: Column, declared: Column) -> Column:
    return F.xxhash64(*[F.coalesce(c, F.lit("")) for c in (host, suffix, declared)])


def identify_language(
    rows: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: Column | None = None, host: Column | None = None,
    suffix: Column | None = None, declared: Column | None = None, least: float = 0.6,
) -> DataFrame:
    """rid, h, e, grams, text_lang, lang, posterior, accepted; one row per distinct id, text and other evidence (``e`` is its hash).

    ``lang`` is the most probable language, ties to the first by name.
    A row is accepted if its text has grams with letters, the posterior is
    ``least`` or more, and a gram's mean log likelihood in ``lang`` is at most
    ``FIT`` below that of the language's own.  Without a host, suffix or declaration (null) that evidence is
    silent; without grams the prior alone decides and the row isn't accepted.
    A model without languages gives null and accepts nothing.  Empty tables
    give empty results.
    """
    langs = model.languages
    text = F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    base = rows.select(
        F.coalesce(col(rows, id_col).cast("long"), F.lit(-(2**63))).alias("rid"), F.xxhash64(text).alias("h"), text.alias("text"),
        F.coalesce(none if host is None else F.lower(host), F.lit("")).alias("host"), F.coalesce(none if suffix is None else F.lower(suffix), F.lit("")).alias("suffix"),
        (none if declared is None else F.lower(F.substring_index(declared, "-", 1))).alias("declared"),
    ).withColumn("e", evidence_key(F.col("host"), F.col("suffix"), F.col("declared")))
    base = text_evidence(base, model).dropDuplicates(["rid", "h", "e"])
    names = F.array(*[F.lit(x) for x in langs]).cast("array<string>")
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    base = base.withColumn("text_lang", F.when(F.col("grams") > 0, best(F.col("log"))))
    base = written(base.select("rid", "h", "e", "host", "suffix", "declared", "text_lang", "grams", "log", "fit"), "evidence")
    if not langs:
        return base.select("rid", "h", "e", "grams", "text_lang", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    votes = F.array(*[F.count(F.when(F.col("text_lang") == x, 1)) for x in langs])
    added = F.array(*[F.sum(F.col("_v")[i]) for i in range(len(langs))])
    own = F.array(*[F.coalesce((F.col("text_lang") == x).cast("long"), F.lit(0)) for x in langs])
    minus = lambda a: F.zip_with(a, own, lambda x, y: x - y)
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # the whole table and each declaration: a row for each language, bounded by the model
    by_lang = {r["text_lang"]: r["n"] for r in base.filter("text_lang is not null").groupBy("text_lang").agg(F.count("*").alias("n")).collect()}
    share = [(by_lang.get(x, 0) + 1.0) / (sum(by_lang.values()) + len(langs)) for x in langs]
    told = {(r["declared"], r["text_lang"]): r["n"] for r in base.filter(F.col("declared").isin(*langs) & F.col("text_lang").isNotNull()).groupBy("declared", "text_lang").agg(F.count("*").alias("n")).collect()}
    seen = group_totals(base, ["host", "suffix"], {"_v": votes}, {"hosts": added}, F.col("h"))
    seen = group_totals(seen, ["suffix"], {"_v": votes}, {"suffixes": added}, F.col("h"))
    glob = F.array(*[F.lit(x) for x in share])
    # a row without a suffix, or a host, has the wider group's prior
    wide = F.when(F.col("suffix") == "", glob).otherwise(F.zip_with(minus(F.col("suffixes")), glob, lambda n, g: (n + SUFFIX_PULL * g) / (sum_of(minus(F.col("suffixes")).cast("array<double>")) + SUFFIX_PULL)))
    prior = F.when(F.col("host") == "", F.col("wide")).otherwise(F.zip_with(minus(F.col("hosts")), F.col("wide"), lambda n, g: (n + HOST_PULL * g) / (sum_of(minus(F.col("hosts")).cast("array<double>")) + HOST_PULL)))
    markup = F.lit(None).cast("array<double>")
    for d in langs:
        n = [told.get((d, x), 0) for x in langs]
        row = [float(np.log((n[i] + 1.0) / (by_lang.get(x, 0) + len(langs)))) for i, x in enumerate(langs)]
        markup = F.when(F.col("declared") == d, F.array(*[F.lit(v) for v in row])).otherwise(markup)
    silent = F.array(*[F.lit(0.0)] * len(langs))
    out = seen.withColumn("wide", wide).withColumn("prior", prior).withColumn("markup", F.coalesce(markup, silent))
    logs = F.zip_with(F.zip_with("log", F.transform("prior", lambda p: F.ln(F.greatest(p, F.lit(1e-9)))), lambda a, b: a + b), "markup", lambda a, b: a + b)
    out = out.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    fit = F.get("fit", F.array_position("logs", F.col("top")).cast("int") - 1)
    out = out.select("rid", "h", "e", "grams", "text_lang", best(F.col("logs")).alias("lang"), posterior.alias("posterior"), fit.alias("fit"))
    return out.withColumn("accepted", (F.col("grams") > 0) & (F.col("posterior") >= least) & (F.col("fit") >= -FIT)).drop("fit")


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*+>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"&[a-zA-Z0-9#]{1,10};", " "), r"\s+", " ")


def page_languages(pages: DataFrame, model: LanguageModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, declared, suffix, text_lang, lang, posterior, accepted; one row per input row.

    Null pages and addresses are empty ones: they have no evidence of that
    kind.  Repeated rows get the same result, rows that share id and text but
    not the address or the declaration each their own.
    """
    html, url = F.coalesce(col(pages, html_col).cast("string"), F.lit("")), F.coalesce(col(pages, url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    suffix = F.when(host == "", host).otherwise(F.substring_index(host, ".", -1))
    said = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    rows = pages.select(col(pages, id_col).alias("doc_id"), page_text(html).alias("text"), host.alias("host"), suffix.alias("suffix"), F.when(said != "", said).alias("declared"))
    found = identify_language(rows, model, "doc_id", F.col("text"), F.col("host"), F.col("suffix"), F.col("declared"))
    keys = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rid"), F.xxhash64("text").alias("h"), evidence_key(F.lower("host"), F.lower("suffix"), F.lower("declared")).alias("e"), "declared", "suffix")
    return keys.join(found, ["rid", "h", "e"]).select(id_out().alias("page_id"), "declared", "suffix", "text_lang", "lang", "posterior", "accepted")


def document_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """rid, h, e, lang, posterior, accepted of documents; their source, if they have that column, takes the place of the host.

    A row of ``docs`` is found again by its id, text and :func:`document_evidence` (``e``).
    """
    base = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"), _host(docs, host_col).alias("host"))
    return identify_language(base, model, "doc_id", F.col("text"), F.col("host"))


def _host(docs: DataFrame, host_col: str) -> Column:
    return col(docs, host_col).cast("string") if host_col in docs.columns else F.lit(None).cast("string")


def document_evidence(docs: DataFrame, host_col: str = "source") -> Column:
    """The ``e`` of :func:`document_languages` for a row of ``docs``."""
    return evidence_key(F.lower(_host(docs, host_col)), F.lit(""), F.lit(None).cast("string"))
