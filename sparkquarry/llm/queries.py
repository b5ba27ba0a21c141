"""The queries ``opN_*``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import decontaminate, proximity_matches
from .exact_dedup import exact_dedup
from .language import page_languages, train_language
from .manifest import merkle_manifest
from .minhash import near_duplicates
from .packing import pack_mixture
from .pii import find_pii
from .piece_codec import encode_documents
from .quotation import link_quotations
from .resample import importance_resample
from .sharding import shard_rows
from .suffix_dedup import remove_repeats
from .toxicity import toxicity

#: Where the vocabulary lies; read on the driver alone.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), size=400).drop("kept_bytes")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), 8)


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(_table(spark, sf_dir, "conversations"))


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model counts all documents."""
    return page_languages(_table(spark, sf_dir, "pages"), train_language(_table(spark, sf_dir, "documents")))


def op7_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL, dropout=0.1, seed=1).drop("ids")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20, buckets=10_000, seed=42).drop("n_words")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"), arity=3)


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:  # on the driver alone
        tokenizer = f.read()
    return pack_mixture(_table(spark, sf_dir, "documents"), tokenizer, size=4096, last=2)


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of a benchmark window stand in order with at most two others between them; exact occurrences are among these."""
    return proximity_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=2, window=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_jump_shards, op4_quotation_links, op5_pii_boosting, op6_language, op7_minmax_neardup, op8_block_naming, op9_piece_dropout, op10_decontaminate, op11_importance_resample, op12_merkle_manifest, op13_mixture_packing, benchmark_proximity)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc_table() -> list[int]:
    """What each byte does to a crc32, by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in table]
    return table


ORACLE = {
    "op7_minmax_neardup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(root) AS root FROM r GROUP BY x) m ON m.x = d.doc_id""",
    "op8_block_naming": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_decontaminate": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
loc AS (SELECT DISTINCT d.doc_id, x.i, x.n, array_to_string(w[x.i:x.i + x.n - 1], ' ') AS p
  FROM d, LATERAL (SELECT i, n FROM (SELECT unnest(range(1, len(w) + 1)) AS i), (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)) x),
hit AS (SELECT loc.doc_id, loc.i, loc.n, win.item_id FROM loc JOIN win ON loc.p = win.p AND loc.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
wt AS (SELECT p, n, unnest(range(1, n + 1)) AS k, unnest(string_split(p, ' ')) AS t FROM (SELECT DISTINCT p, n FROM win)),
wpos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM d),
near AS (SELECT doc_id, j AS s, j AS e, p, n, k FROM wpos JOIN wt ON wpos.t = wt.t AND k = 1
  UNION ALL SELECT near.doc_id, s, min(j), near.p, near.n, wt.k FROM near JOIN wt ON wt.p = near.p AND wt.k = near.k + 1 JOIN wpos ON wpos.doc_id = near.doc_id AND wpos.t = wt.t AND j > near.e AND j < s + near.n + 2 GROUP BY ALL),
nearest AS (SELECT doc_id, count(DISTINCT p) AS n_near FROM near WHERE k = n GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated, coalesce(nearest.n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nearest USING (doc_id)""",
    "op11_importance_resample": f"""
WITH w AS (SELECT 0 AS k, doc_id AS id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT k, id, f, count(*) AS c FROM (SELECT k, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n) GROUP BY ALL),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
  lambda s, v: xor(s >> 8, ({_crc_table()}::BIGINT[])[xor(s & 255, v) + 1]))) % 10000 AS b FROM x),
n AS (SELECT k, id, b, sum(c)::BIGINT AS c FROM f JOIN b USING (f) GROUP BY ALL),
g AS (SELECT coalesce(s.b, t.b) AS b, coalesce(s.c, 0) AS s, coalesce(t.c, 0) AS t, (SELECT coalesce(sum(c), 0) FROM n WHERE k = 0)::DOUBLE AS all_s, (SELECT coalesce(sum(c), 0) FROM n WHERE k = 1)::DOUBLE AS all_t
  FROM (SELECT b, sum(c) AS c FROM n WHERE k = 0 GROUP BY b) s FULL JOIN (SELECT b, sum(c) AS c FROM n WHERE k = 1 GROUP BY b) t ON s.b = t.b),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM g),
d AS (SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM n JOIN gain USING (b) WHERE k = 0 GROUP BY id),
z AS (SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('42:', w.id::VARCHAR)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM w LEFT JOIN d ON d.id = w.id WHERE k = 0),
r AS (SELECT *, weight + noise AS score, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) END AS place, 5 * (count(*) FILTER (n_words >= 20) OVER ()) // 100 AS most FROM z)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= most THEN place END::BIGINT AS rank FROM r""",
    "op12_merkle_manifest": """
WITH RECURSIVE b AS (
  SELECT *, hex(encode(doc_id::VARCHAR)) AS x FROM documents),
c AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(4 * len(x)),
    lambda i: ((('0x' || x[2 * (i // 8) + 1 : 2 * (i // 8) + 2])::BIGINT >> (i % 8)) & 1))),
    lambda s, bit: xor(s >> 1, 3988292384::BIGINT * (xor(s, bit) & 1)))) AS crc FROM b),
d AS (
  SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM c),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (
  SELECT source, 0 AS l, i, n, leaf AS h FROM leaf
  UNION ALL SELECT source, l + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, l, i // 3),
top AS (
  SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
r AS (
  SELECT 0 AS l, i, n, h FROM top
  UNION ALL SELECT l + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM r WHERE n > 1 GROUP BY l, i // 3),
own AS (
  SELECT doc_id, source, 0 AS l, i, n FROM leaf
  UNION ALL SELECT doc_id, source, l + 1, i // 3, (n + 2) // 3 FROM own WHERE n > 1),
above AS (
  SELECT source, 0 AS l, i, n FROM top
  UNION ALL SELECT source, l + 1, i // 3, (n + 2) // 3 FROM above WHERE n > 1),
high AS (SELECT source, max(l) AS high FROM own GROUP BY source),
steps AS (
  SELECT doc_id, own.l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < own.i), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > own.i), '') AS after
  FROM own JOIN t ON t.source IS NOT DISTINCT FROM own.source AND t.l = own.l AND t.i // 3 = own.i // 3 WHERE own.n > 1 GROUP BY doc_id, own.l, own.i
  UNION ALL
  SELECT doc_id, high + u.l, u.before, u.after FROM leaf JOIN high ON high.source IS NOT DISTINCT FROM leaf.source JOIN (
    SELECT source, above.l, coalesce(string_agg(r.h, '' ORDER BY r.i) FILTER (r.i < above.i), '') AS before, coalesce(string_agg(r.h, '' ORDER BY r.i) FILTER (r.i > above.i), '') AS after
    FROM above JOIN r ON r.l = above.l AND r.i // 3 = above.i // 3 WHERE above.n > 1 GROUP BY source, above.l, above.i) u ON u.source IS NOT DISTINCT FROM leaf.source),
proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY l)) AS p, count(*) AS n FROM steps GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0 AS l, changed AS h FROM leaf
  UNION ALL SELECT fold.doc_id, fold.l + 1, sha256(before || h || after) FROM fold JOIN steps ON steps.doc_id = fold.doc_id AND steps.l = fold.l),
done AS (SELECT fold.doc_id, fold.h FROM fold LEFT JOIN proof USING (doc_id) WHERE fold.l = coalesce(proof.n, 0))
SELECT leaf.doc_id, leaf.leaf, top.h AS subroot, root.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256, done.h AS folded_root, done.h = root.h AS verified
FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source JOIN done ON done.doc_id = leaf.doc_id LEFT JOIN proof ON proof.doc_id = leaf.doc_id
CROSS JOIN (SELECT h FROM r WHERE n = 1) root""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
