"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

All stages but the last return the columns they were given, whatever these are
called.  A null text is an empty one and has no language, so it goes with the
first stage.  A null id is an id like others, the smallest.  Rows that share id
and text are judged alike, but by the language stage if their sources differ;
the two deduplicating stages keep one of them, the first in the order of all
columns.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm.common import discard, keep_rows, temporary, written
from sparkquarry.llm.decontaminate import hit_documents
from sparkquarry.llm.exact_dedup import equal_groups
from sparkquarry.llm.language import document_evidence, document_languages, train_language
from sparkquarry.llm.minhash import near_groups
from sparkquarry.llm.piece_codec import encode_documents
from sparkquarry.llm.queries import PIECE_MODEL


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; those without letters, or torn between languages, go."""
    found = document_languages(docs, train_language(docs))
    return keep_rows(docs, found.filter("accepted"), e=document_evidence(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return keep_rows(docs, equal_groups(docs).filter("kept"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 of five-word shingles, the one with the smallest id stays."""
    return keep_rows(docs, near_groups(docs, "doc_id", "text", k=5, num=80, den=100).filter("kept"), once=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all of a shorter one, go."""
    hit = hit_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return keep_rows(docs, hit.filter("not contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with proof that they decode to its text."""
    return encode_documents(docs, PIECE_MODEL, dropout=0.1, seed=1)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: Language posteriors and keyed merge-dropout are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages are deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
