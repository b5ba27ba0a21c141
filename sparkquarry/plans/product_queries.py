"""Product analytics, personal data, duplicates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as VX
from ..operators import dedup as D
from ..operators import pii as P
from ..operators import product as PR
from ..operators import vector_index as VI
from ..streaming import windows as ST
from .registry import query

_ACT = "SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS this_week, count(*) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS last_week, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17') AS before_last, count(*) AS in_month, user_id % 60 AS age, ['free', 'paid', 'enterprise'][1 + user_id % 3] AS plan, 1 + user_id % 5 AS satisfaction, count(DISTINCT event_type) AS features FROM events GROUP BY user_id"


def _activity(t):
    ts, at = F.col("ts"), lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    u = F.col("user_id")
    a = t.events.groupBy("user_id").agg(F.count_if(ts >= at(24)).alias("this_week"), F.count_if((ts >= at(17)) & (ts < at(24))).alias("last_week"), F.count_if((ts >= at(10)) & (ts < at(17))).alias("before_last"), F.count("*").alias("in_month"), F.count_distinct("event_type").alias("features"))
    return a.withColumns({"age": u % 60, "plan": F.get(F.array(F.lit("free"), F.lit("paid"), F.lit("enterprise")), (u % 3).cast("int")), "satisfaction": 1 + u % 5})


@query(f"SELECT user_id, CASE WHEN in_month > 100 THEN 'power' WHEN age <= 7 THEN 'new' WHEN before_last > 0 AND (before_last - last_week)::DOUBLE / before_last > 0.3 THEN 'at_risk' WHEN plan = 'enterprise' THEN 'enterprise' WHEN plan = 'paid' THEN 'paid' ELSE 'free' END AS cohort FROM ({_ACT})")
def cohort_v1(t):
    return _activity(t).select("user_id", PR.cohort("plan", "age", "in_month", "last_week", "before_last").alias("cohort"))


_V2 = f"""SELECT user_id, this_week, CASE WHEN this_week > 20 AND age < 30 THEN 'new_power' WHEN this_week > 20 THEN 'sustained_power' WHEN trend > 0.2 THEN 'growing' WHEN trend < -0.3 AND this_week >= 10 THEN 'at_risk' WHEN this_week < 10 AND satisfaction >= 4 THEN 'casual' WHEN this_week < 10 AND satisfaction < 3 THEN 'churning' ELSE 'normal' END AS cohort
FROM (SELECT *, CASE WHEN last_week > 0 THEN (this_week - last_week)::DOUBLE / last_week ELSE 0 END AS trend FROM ({_ACT}))"""


@query(f"SELECT user_id, cohort FROM ({_V2})")
def cohort_v2(t):
    """With 20 events a week as the bound of heavy use, which suits the test data."""
    return _activity(t).select("user_id", PR.cohort_by_trend("age", "this_week", "last_week", "satisfaction", high=20, low=10).alias("cohort"))


@query(f"SELECT coalesce(cohort, 'all') AS cohort, count(*) AS users, sum(this_week)::BIGINT AS events FROM ({_V2}) GROUP BY ROLLUP (cohort)")
def cohort_rollup(t):
    c = _activity(t).withColumn("cohort", PR.cohort_by_trend("age", "this_week", "last_week", "satisfaction", high=20, low=10))
    return c.rollup("cohort").agg(F.count("*").alias("users"), F.sum("this_week").alias("events")).withColumn("cohort", F.coalesce("cohort", F.lit("all")))


@query(f"SELECT user_id, least(100, in_month / 20.0 * 30 + satisfaction / 5.0 * 50 + features / 5.0 * 20)::DOUBLE AS engagement FROM ({_ACT})", ("engagement",))
def engagement_score(t):
    return _activity(t).select("user_id", PR.engagement(F.col("in_month"), F.col("satisfaction"), F.col("features")).alias("engagement"))


@query("SELECT c_mktsegment AS cohort, sum(l_extendedprice * l_discount) / 1e3 AS cost, count(DISTINCT c_custkey) AS users, sum(l_extendedprice * l_discount) / 1e3 / count(DISTINCT c_custkey) AS cost_per_user FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", ("cost", "cost_per_user"))
def cost_per_user(t):
    j = t.customer.select("c_custkey", F.col("c_mktsegment").alias("cohort")).join(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey")
    cost = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / 1e3).alias("cost"))
    return PR.per_user(j.join(cost, "o_orderkey"), "cohort", "c_custkey", "cost")


@query("SELECT o_orderpriority AS cohort, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS revenue, sum(l_extendedprice * l_discount) / 1e6 AS cost, sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice * l_discount) AS roai FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", ("revenue", "cost", "roai"))
def roai(t):
    """Revenue and cost in millions, and their ratio."""
    line = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("c"))
    j = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("cohort")).join(line, "o_orderkey").groupBy("cohort").agg((F.sum("r") / 1e6).alias("revenue"), (F.sum("c") / 1e6).alias("cost"))
    return j.withColumn("roai", F.when(F.col("cost") > 0, F.col("revenue") / F.col("cost")))


@query("SELECT event_type AS feature, count(*) AS uses, count(DISTINCT user_id) AS users, count(DISTINCT user_id)::DOUBLE / (SELECT count(DISTINCT user_id) FROM events) AS adoption, avg((value > 5)::INT) AS success FROM events GROUP BY 1", ("adoption", "success"))
def feature_adoption(t):
    f = t.events.groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("uses"), F.count_distinct("user_id").alias("users"), F.avg((F.col("value") > 5).cast("double")).alias("success"))
    return f.join(t.events.agg(F.count_distinct("user_id").alias("_n"))).withColumn("adoption", F.col("users") / F.col("_n")).drop("_n")


_WEEK = "SELECT DISTINCT user_id, date_trunc('week', ts)::DATE AS week FROM events"


@query(f"WITH w AS ({_WEEK}) SELECT a.week, count(*) AS active, count(b.user_id) AS retained, count(b.user_id)::DOUBLE / count(*) AS retention FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.week = a.week + 7 GROUP BY 1", ("retention",))
def cohort_retention(t):
    return PR.retention(t.events.select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).distinct())


@query(f"WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, week, n, lag(n) OVER (PARTITION BY user_id ORDER BY week) AS before, CASE WHEN lag(n) OVER (PARTITION BY user_id ORDER BY week) > 0 THEN (n - lag(n) OVER (PARTITION BY user_id ORDER BY week))::DOUBLE / lag(n) OVER (PARTITION BY user_id ORDER BY week) END AS change FROM w", ("change",))
def week_over_week(t):
    return PR.period_change(t.events.groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n")), ["user_id"], "week", "n")


@query("SELECT user_id, event_type, count(*) AS n, 1 - pow(0.95::DOUBLE, sum(ok)) AS as_is, sum(ok * 0.05 * pow(0.95::DOUBLE, rn - 1)) AS corrected FROM (SELECT user_id, event_type, (value > 5)::INT AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1, 2", ("as_is", "corrected"))
def feature_success_ema(t):
    """Both modes of the moving average: as it stands, updated on success only, and corrected."""
    return PR.success_ema(t.events.select("user_id", "event_type", "ts", "event_id", (F.col("value") > 5).alias("ok")), ["user_id", "event_type"])


# personal data
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity, unnest(regexp_extract_all(text, '{p}')) AS match, {s}::DOUBLE AS score FROM documents" for e, p, s in P.PATTERNS)

@query(_FOUND)
def pii_detect(t):
    return P.detect(t.documents)


@query(f"SELECT doc_id, entity, match, CASE entity WHEN 'EMAIL_ADDRESS' THEN string_split(match, '@')[-1] IN ('example.com', 'test.com', 'localhost') WHEN 'US_SSN' THEN match IN ('123-45-6789', '000-00-0000', '111-11-1111') WHEN 'PHONE_NUMBER' THEN regexp_replace(match, '[\\s\\-()]', '', 'g') IN ('5555555555', '5551234') ELSE false END AS skipped FROM ({_FOUND}) WHERE score >= 0.7")
def pii_whitelist(t):
    return P.detect(t.documents, min_score=0.7).select("doc_id", "entity", "match", P.whitelisted(F.col("entity"), F.col("match")).alias("skipped"))


def _nested(patterns, inner="text"):
    for p, to in patterns:
        inner = f"regexp_replace({inner}, '{p}', '{to}', 'g')"
    return inner


@query(f"SELECT doc_id, {_nested([(p, P.PLACEHOLDER.get(e, f'<{e}>')) for e, p, _ in P.PATTERNS])} AS text FROM documents")
def pii_redact_replace(t):
    return t.documents.select("doc_id", P.redact(F.col("text")).alias("text"))


def _masked_sql():
    sql = "SELECT doc_id, text FROM documents"
    for entity, p, _ in P.PATTERNS:
        n = "least(length(z[2]), 4)" if entity == "EMAIL_ADDRESS" else "length(z[2])"
        pieces = f"list_zip(string_split_regex(text, '{p}'), list_append(regexp_extract_all(text, '{p}'), ''))"
        sql = f"SELECT doc_id, array_to_string(list_transform({pieces}, lambda z: concat(z[1], repeat('*', {n}), substr(z[2], {n} + 1))), '') AS text FROM ({sql})"
    return sql


@query(_masked_sql())
def pii_redact_mask(t):
    return t.documents.select("doc_id", P.redact(F.col("text"), "mask").alias("text"))


def _hashed_sql():
    sql = "SELECT doc_id, text FROM documents"
    for entity, p, _ in P.PATTERNS:
        pieces = f"list_zip(string_split_regex(text, '{p}'), list_append(regexp_extract_all(text, '{p}'), NULL))"
        sql = f"SELECT doc_id, array_to_string(list_transform({pieces}, lambda z: concat(z[1], CASE WHEN z[2] IS NULL THEN '' ELSE concat('<{entity}_', substr(md5(z[2]), 1, 6), '>') END)), '') AS text FROM ({sql})"
    return sql


@query(_hashed_sql())
def pii_redact_hash(t):
    return t.documents.select("doc_id", P.redact(F.col("text"), "hash").alias("text"))


@query(f"SELECT doc_id, {_nested([(p, f'[{n}_REDACTED]') for n, p in P.LOG_MASKS])} AS line FROM documents")
def log_mask(t):
    return t.documents.select("doc_id", P.mask_log(F.col("text")).alias("line"))


@query(f"SELECT (SELECT count(*) FROM documents) AS n_documents, count(DISTINCT doc_id) AS with_pii, count(*) AS entities, count(DISTINCT doc_id) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS share FROM ({_FOUND})", ("share",))
def pii_doc_stats(t):
    f = P.detect(t.documents).agg(F.count_distinct("doc_id").alias("with_pii"), F.count("*").alias("entities"))
    return f.join(t.documents.agg(F.count("*").alias("n_documents"))).withColumn("share", F.col("with_pii") * 100.0 / F.col("n_documents"))


@query(f"SELECT doc_id, regexp_matches(text, '\\d{{3}}-\\d{{2}}-\\d{{4}}|\\d{{16}}') AS rejected FROM documents")
def pii_reject_upload(t):
    return t.documents.select("doc_id", P.rejects(F.col("text")).alias("rejected"))


# duplicates
@query("SELECT doc_id, md5(text) AS digest, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def exact_duplicates(t):
    d = t.documents.select("doc_id", F.md5("text").alias("digest"))
    return D.totals_beside(d, "digest", {"copies": F.count("*"), "first_id": F.min("doc_id")}).select("doc_id", "digest", "copies", "first_id")


_TOK = "SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS token FROM documents"
_PAIRS = f"WITH k AS ({_TOK}), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM k x JOIN k y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY 1, 2) SELECT a, b, i::DOUBLE / (p.n + q.n - i) AS similarity FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE i::DOUBLE / (p.n + q.n - i) >= 0.85"


@query(_PAIRS, ("similarity",))
def jaccard_pairs(t):
    return D.similar_pairs(D.token_sets(t.documents), 0.85)


@query(f"SELECT p.* FROM ({_PAIRS}) p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.lang = y.lang AND x.source = y.source", ("similarity",))
def date_aware_dedup(t):
    """Pairs count only where a further field agrees, as dates would; here language and source."""
    return D.similar_pairs(D.token_sets(t.documents), 0.85, fields=t.documents.select("doc_id", "lang", "source"))


_SECTION = """WITH RECURSIVE k AS (SELECT doc_id, unnest(list_distinct(list_append(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), 'section:' || lang))) AS token FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM k x JOIN k y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE i::DOUBLE / (p.n + q.n - i) >= 0.85),
r AS (SELECT doc_id, doc_id AS g FROM n UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.doc_id WHERE r.g < e.b)
SELECT doc_id, min(g) AS "group" FROM r GROUP BY 1"""


@query(_SECTION)
def near_duplicates_minhash(t):
    """Groups of documents linked by a similarity of 0.85 of words and section, found by 128 minima in 32 bands."""
    return D.similar_groups(t.documents, 0.85, extra=F.concat(F.lit("section:"), F.col("lang")))


_GREEDY = f"""WITH RECURSIVE p AS ({_PAIRS}), nb AS (SELECT b, list(a ORDER BY a) AS before FROM p GROUP BY 1), o AS (SELECT doc_id, coalesce(before, []) AS before, row_number() OVER (ORDER BY doc_id) AS i FROM documents LEFT JOIN nb ON b = doc_id WHERE doc_id IN (SELECT a FROM p UNION SELECT b FROM p)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(r.kept, o.before) THEN r.kept ELSE list_append(r.kept, o.doc_id) END FROM r JOIN o ON o.i = r.i + 1),
k AS (SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)),
best AS (SELECT b, a FROM p WHERE a IN (SELECT doc_id FROM k) QUALIFY row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) = 1)
SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT b FROM p) AND d.doc_id NOT IN (SELECT doc_id FROM k) THEN best.a END AS duplicate_of FROM documents d LEFT JOIN best ON best.b = d.doc_id"""


@query(_GREEDY)
def greedy_dedup(t):
    return D.greedy_sets(t.documents, D.token_sets(t.documents), 0.85)


@query(
    "SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) >= 0.9",
    ("similarity",),
)
def semantic_dedup(t):
    """Vectors of one namespace with a cosine of 0.9 or more; the vectors have unit length."""
    return VI.pairs_within(VI.build(t.embeddings, "vec_id", "embedding"), "vec_id", 0.9, ["label"])


# streams: run to the end of the table and compared with SQL over it
def _stream(t):
    return ST.read_events(t.spark, f"{t.dir}/events.parquet*", t.events.schema)


def _drained(t, stream, name, mode):
    from ..sources.shared import shared_path

    return ST.drain(stream, shared_path(t.spark, name), mode)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", ("total",))
def stream_tumbling(t):
    out = _drained(t, ST.tumbling(_stream(t)), "stream_tumbling", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("SELECT w AS start_at, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP - INTERVAL 15 MINUTE * i FOR i IN range(4)]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding(t):
    out = _drained(t, ST.sliding(_stream(t)), "stream_sliding", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n")


@query(
    "WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM b GROUP BY user_id, s"
)
def stream_session_incidents(t):
    out = _drained(t, ST.sessions(_stream(t)), "stream_session_incidents", "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start_at"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    """One batch knows no expiry, so what is left is one row of each key."""
    return _drained(t, ST.deduplicated(_stream(t), ["user_id", "event_type"]), "stream_dedup", "append").select("user_id", "event_type")
