"""Exact deduplication by deterministic block naming (Karp, Miller, Rosenberg).

Texts are cut into fixed-size blocks.  The distinct blocks are sorted and get
integer names; then adjacent names are paired and the distinct pairs are
named, level by level, until each text has one name.  Two texts of equally
many blocks have the same name exactly if they are equal: names stand for
sorted values, not for hashes, so nothing can collide.

Scale.  The blocks' bytes are shuffled once, after a dictionary per Arrow
batch has dropped the batch's repeats: a block that a third of all documents
share travels once per batch, and its occurrences stay where they are, as
references to the batch's first one.  Pairs of names are named by grouped
aggregation with salted joins.  Levels number as the logarithm of the longest
text's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_totals, id_out, keyed, written

#: Code points in a block.
BLOCK = 2048
#: Names of one task's blocks start at its number times this.
SPAN = 1 << 40


def _blocks(texts: DataFrame, block: int) -> DataFrame:
    """rid, h, pos, block; an empty text is one empty block."""
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    return texts.select("rid", "h", F.posexplode(cut).alias("pos", "block"))


def _dictionary(only_first: bool):
    """Per batch, the first occurrence of each distinct block: as rows with the block, or as reference of every occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column("block").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            if only_first:
                yield b.take(pa.array(np.sort(first)))
            else:
                ref = b.take(pa.array(first[inverse]))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("rid", "h", "pos")), *(ref.column(k) for k in ("rid", "h", "pos"))], ["rid", "h", "pos", "ref_rid", "ref_h", "ref_pos"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names blocks that come sorted: a new name wherever the block differs from the one before."""
    from pyspark import TaskContext

    at, last = TaskContext.get().partitionId() * SPAN - 1, None
    for b in batches:
        if not b.num_rows:
            continue
        values = b.column("block").cast(pa.large_binary())
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
        new[0] = values[0].as_py() != last
        name = at + np.cumsum(new)
        at, last = int(name[-1]), values[-1].as_py()
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("h"), b.column("pos"), pa.array(name)], ["ref_rid", "ref_h", "ref_pos", "name"])


def text_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """rid, h, n_blocks, name of each distinct (rid, h) of ``texts`` (rid, h, text).

    ``texts`` is read twice and must give the same rows in the same order each
    time, as a scan of files does; a reference without its block raises.
    """
    blocks = _blocks(texts, block)
    occurrences = blocks.mapInArrow(_dictionary(False), "rid long, h long, pos int, ref_rid long, ref_h long, ref_pos int")
    sorted_blocks = blocks.mapInArrow(_dictionary(True), "rid long, h long, pos int, block string").repartition("block").sortWithinPartitions("block")
    names = sorted_blocks.mapInArrow(_named, "ref_rid long, ref_h long, ref_pos int, name long").distinct()
    found = occurrences.join(names, ["ref_rid", "ref_h", "ref_pos"], "left")
    found = found.select("rid", "h", "pos", F.coalesce("name", F.raise_error(F.lit("the texts changed between two reads; write them to a table first")).cast("long")).alias("name"))
    rows = found.distinct().groupBy("rid", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    level = written(rows.withColumn("n_blocks", F.size("names")), "names")
    done = []
    while True:
        done.append(level.filter(F.size("names") == 1).select("rid", "h", "n_blocks", F.element_at("names", 1).alias("name")))
        level = level.filter(F.size("names") > 1)
        if level.isEmpty():
            break
        # -1 stands beside the last of an odd number
        paired = F.transform(F.sequence(F.lit(0), ((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(i.alias("pos"), F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")))
        pairs = level.select("rid", "h", "n_blocks", F.explode(paired).alias("x")).select("rid", "h", "n_blocks", "x.*")
        rank = pairs.select("a", "b").distinct().repartition("a", "b").sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        rank = written(rank, "pairs")
        # a pair's name goes back to its occurrences in salted sub-groups
        salt = F.pmod(F.xxhash64("rid", "h"), F.lit(64)).cast("int")
        salted = pairs.withColumn("salt", salt)
        cells = salted.select("a", "b", "salt").distinct().join(rank, ["a", "b"])
        back = salted.join(cells, ["a", "b", "salt"]).groupBy("rid", "h", "n_blocks").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
        level = written(back.select("rid", "h", "names", "n_blocks"), "names")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """rid, h, keep_id, group_size, kept, text_sha256; see :func:`exact_dedup`."""
    texts = keyed(docs, id_col, text_col).select("rid", F.xxhash64("text").alias("h"), "text")
    named = text_names(texts, block)
    sums = texts.select("rid", "h", F.sha2("text", 256).alias("text_sha256"))
    rows = sums.join(named, ["rid", "h"])
    members = rows.groupBy("rid", "h", "n_blocks", "name").agg(F.count("*").alias("_rows"))
    groups = group_totals(members, ["n_blocks", "name"], {"_k": F.max("rid"), "_n": F.sum("_rows")}, {"keep_id": F.max("_k"), "group_size": F.sum("_n")}, F.col("rid"))
    back = sums.join(groups.select("rid", "h", "keep_id", "group_size"), ["rid", "h"])
    nth = F.row_number().over(Window.partitionBy("rid", "h").orderBy("text_sha256"))
    return back.select("rid", "h", "keep_id", "group_size", ((F.col("rid") == F.col("keep_id")) & (nth == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Of equal texts the row with the largest id stays.  Null text: empty text.
    A null id sorts below all others and comes out null.  Of repeated rows
    (same id and text) all are counted and one stays.  An empty table gives an
    empty result.  ``docs`` must be a stable read, see :func:`text_names`.
    """
    found = equal_groups(docs, id_col, text_col, block)
    return found.select(id_out().alias("doc_id"), id_out("keep_id").alias("keep_id"), "group_size", "kept", "text_sha256")
