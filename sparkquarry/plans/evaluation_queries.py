"""Evaluation, human review and traces: conversations are query logs, labels are two annotators, events are scores, feedback and spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import hashed_order, unit_interval
from ..operators import evaluation as V
from .registry import query

METRICS = list(V.WEIGHTS)
# four scores in [0, 1] from hashes of a user's id
_U = "concat('0x', substr(md5(concat({k}::VARCHAR, ':{m}')), 1, 8))::UBIGINT::DOUBLE / 4294967296"
SCORES = "SELECT user_id, " + ", ".join(f"0.4 + 0.6 * {_U.format(k='user_id', m=m)} AS {m}" for m in METRICS) + " FROM (SELECT DISTINCT user_id FROM events)"


def _scores(t):
    return t.events.select("user_id").distinct().withColumns({m: 0.4 + 0.6 * unit_interval(F.concat(F.col("user_id").cast("string"), F.lit(f":{m}"))) for m in METRICS})


def _long(t):
    return _scores(t).unpivot(["user_id"], METRICS, "metric", "score")


_LONG = " UNION ALL ".join(f"SELECT user_id, '{m}' AS metric, {m} AS score FROM ({SCORES})" for m in METRICS)


@query(
    f"SELECT user_id, {' + '.join(f'{m} * {w}' for m, w in V.WEIGHTS.items())} AS overall, concat_ws(', ', {', '.join(f'CASE WHEN {m} < 0.7 THEN {chr(39)}{m}{chr(39)} END' for m in METRICS)}) AS low FROM ({SCORES})",
    ("overall",),
)
def overall_score(t):
    c = {m: F.col(m) for m in METRICS}
    return _scores(t).select("user_id", V.overall(c).alias("overall"), F.array_join(V.low_metrics(c), ", ").alias("low"))


_BASE = f"""WITH l AS ({_LONG}), c AS (SELECT metric, avg(score) AS s FROM l WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT metric, avg(score) + 0.03 * (length(metric) - 15) AS s FROM l WHERE user_id % 2 = 1 AND metric <> 'context_recall' GROUP BY 1),
j AS (SELECT c.metric, c.s AS current, coalesce(b.s, 0) AS baseline, c.s - coalesce(b.s, 0) AS delta FROM c LEFT JOIN b USING (metric))
SELECT *, CASE WHEN baseline > 0 THEN delta / baseline * 100 ELSE 0 END AS percent_change, CASE WHEN round(delta, 9) < -0.1 THEN 'regression_high' WHEN round(delta, 9) < -0.05 THEN 'regression_medium' WHEN round(delta, 9) > 0.05 THEN 'improvement' ELSE 'stable' END AS verdict FROM j"""


@query(_BASE, ("current", "baseline", "delta", "percent_change"))
def baseline_regression(t):
    mean = lambda d: d.groupBy("metric").agg(F.avg("score").alias("score"))
    base = mean(_long(t).filter("user_id % 2 = 1 AND metric <> 'context_recall'")).withColumn("score", F.col("score") + 0.03 * (F.length("metric") - 15))
    return V.against_baseline(mean(_long(t).filter("user_id % 2 = 0")), base)


@query(f"SELECT bool_and(current >= baseline) AS update_if_all_better, NOT bool_or(verdict LIKE 'regression%') AS update_if_no_regression FROM ({_BASE})")
def baseline_update(t):
    return baseline_regression(t).agg(F.bool_and(F.col("current") >= F.col("baseline")).alias("update_if_all_better"), (~F.bool_or(F.col("verdict").startswith("regression"))).alias("update_if_no_regression"))


_T = "CASE metric " + " ".join(f"WHEN '{m}' THEN {b}" for m, b in V.THRESHOLDS["compliance"].items()) + " ELSE 0.7 END"


@query(
    f"""WITH l AS (SELECT *, ({_T})::DOUBLE AS threshold FROM ({_LONG})), m AS (SELECT *, score - threshold AS margin, round(score - threshold, 9) >= 0 AS passed, round(threshold - score, 9) AS gap FROM l)
    SELECT user_id, metric, score, threshold, margin, passed, CASE WHEN passed THEN NULL WHEN gap > 0.2 THEN 'critical' WHEN gap > 0.1 THEN 'high' WHEN gap > 0.05 THEN 'medium' ELSE 'low' END AS severity FROM m""",
    ("score", "margin"),
)
def domain_thresholds(t):
    return V.against_thresholds(_long(t), "compliance")


@query("SELECT event_type, sum(m * n) / sum(n) AS score, sum(n)::BIGINT AS n FROM (SELECT event_type, user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1", ("score",))
def weighted_merge(t):
    parts = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("score"), F.count("*").alias("n"))
    return V.weighted_merge(parts, ["event_type"])


@query("WITH r AS (SELECT event_type, user_id, ts, event_id, value < 10 AS low FROM events) SELECT event_id, coalesce(low AND lag(low, 1) OVER w AND lag(low, 2) OVER w, false) AS fires FROM r WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)")
def consecutive_regression(t):
    return V.consecutive_low(t.events, ["event_type", "user_id"], "ts", "value", F.lit(10)).select("event_id", "fires")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) SELECT doc_id FROM r WHERE (rn - 1) % 10 = 0 ORDER BY rn LIMIT 50")
def stride_sample(t):
    """Every tenth document, 50 at most. Only the first 500 can be chosen."""
    first = t.documents.select("doc_id").orderBy("doc_id").limit(500)
    return V.numbered(first, [F.col("doc_id")]).filter("(rn - 1) % 10 = 0").select("doc_id")


@query("WITH n AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS a FROM documents GROUP BY 1), r AS (SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5(concat(doc_id::VARCHAR, ':42')), doc_id) AS rn, floor(100 * n.n / n.a) AS q FROM documents d JOIN n ON d.lang = n.lang) SELECT doc_id, lang FROM r WHERE rn <= q")
def stratified_sample(t):
    return V.stratified(t.documents.select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "lang")


_CAT = "CASE WHEN text LIKE 'What is%' THEN 'definition' WHEN lower(text) LIKE '%how does%' OR lower(text) LIKE '%explain%' THEN 'explanation' WHEN lower(text) LIKE '%what are%' AND (lower(text) LIKE '%requirements%' OR lower(text) LIKE '%steps%') THEN 'procedural' WHEN lower(text) LIKE '%compare%' OR lower(text) LIKE '%difference%' THEN 'comparison' WHEN lower(text) LIKE '%should%' OR lower(text) LIKE '%recommend%' THEN 'recommendation' ELSE 'other' END"
# questions are put together from ids, as invented prose has none of the words
_Q = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'What is ' WHEN 1 THEN 'Explain ' WHEN 2 THEN 'What are the steps of ' WHEN 3 THEN 'Compare ' ELSE 'Tell me ' END"


def _asked(t):
    k = (F.col("conv_id") + F.col("turn")) % 5
    start = F.when(k == 0, "What is ").when(k == 1, "Explain ").when(k == 2, "What are the steps of ").when(k == 3, "Compare ").otherwise("Tell me ")
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.concat(start, F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, {_CAT} AS category FROM (SELECT conv_id, turn, concat({_Q}, text) AS text FROM conversations WHERE role = 'user')")
def query_categories(t):
    return _asked(t).select("conv_id", "turn", T.query_category(F.col("text")).alias("category"))


@query(
    f"""WITH q AS (SELECT conv_id, turn, {_CAT} AS category FROM (SELECT conv_id, turn, concat({_Q}, text) AS text FROM conversations WHERE role = 'user')),
    p AS (SELECT category, count(*)::DOUBLE / (SELECT count(*) FROM q) AS production FROM q GROUP BY 1), g AS (SELECT category, count(*)::DOUBLE / (SELECT count(*) FROM q WHERE conv_id % 3 = 0) AS golden FROM q WHERE conv_id % 3 = 0 GROUP BY 1)
    SELECT coalesce(p.category, g.category) AS category, coalesce(golden, 0) AS golden, coalesce(production, 0) AS production, abs(coalesce(golden, 0) - coalesce(production, 0)) > 0.15 AS flagged FROM p FULL JOIN g ON p.category = g.category""",
    ("golden", "production"),
)
def category_coverage(t):
    q = _asked(t).select("conv_id", T.query_category(F.col("text")).alias("category"))

    def shares(d, name):
        n = d.groupBy("category").agg(F.count("*").alias("n"))
        return n.join(n.agg(F.sum("n").alias("a"))).select("category", (F.col("n") / F.col("a")).alias(name))

    j = shares(q.filter("conv_id % 3 = 0"), "golden").join(shares(q, "production"), "category", "full")
    j = j.select("category", F.coalesce("golden", F.lit(0.0)).alias("golden"), F.coalesce("production", F.lit(0.0)).alias("production"))
    return j.withColumn("flagged", F.abs(F.col("golden") - F.col("production")) > 0.15)


@query("SELECT ts::DATE AS day, count(*) FILTER (value >= 20) AS up, count(*) FILTER (value < 20) AS down, CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (value >= 20)::DOUBLE / count(*) END AS satisfaction FROM events WHERE event_type = 'click' GROUP BY 1", ("satisfaction",))
def satisfaction_score(t):
    e = t.events.filter("event_type = 'click'").groupBy(F.to_date("ts").alias("day"))
    return e.agg(F.count_if(F.col("value") >= 20).alias("up"), F.count_if(F.col("value") < 20).alias("down"), F.coalesce(F.try_divide(F.count_if(F.col("value") >= 20).cast("double"), F.count("value")), F.lit(0.0)).alias("satisfaction"))


@query("SELECT doc_id, len(list_filter(['the', 'and', 'tion', 'sch', 'que'], lambda k: contains(lower(text), k)))::DOUBLE / 5 AS coverage FROM documents", ("coverage",))
def keyword_coverage(t):
    low = F.lower("text")
    return t.documents.select("doc_id", (sum((low.contains(k).cast("int") for k in ("the", "and", "tion", "sch", "que")), F.lit(0)) / F.lit(5.0)).alias("coverage"))


# feedback: every event is rated
FEEDBACK = "SELECT event_id AS id, user_id, ts, CASE WHEN value < 15 THEN 'down' ELSE 'up' END AS thumbs, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1 + event_id % 5 END AS rating, event_id % 3 AS processed, ['verbose', 'technical', 'sources', 'context'][1 + event_id % 4] AS issue FROM events"


def _feedback(t):
    i = F.col("event_id")
    return t.events.select(
        i.alias("id"), "user_id", "ts", F.when(F.col("value") < 15, "down").otherwise("up").alias("thumbs"), F.when(i % 4 == 0, F.lit(None)).otherwise(1 + i % 5).alias("rating"),
        (i % 3).alias("processed"), F.get(F.array(*map(F.lit, ("verbose", "technical", "sources", "context"))), (i % 4).cast("int")).alias("issue"),
    )


@query(f"SELECT count(*) AS total, count(*) FILTER (thumbs = 'up') AS up, count(*) FILTER (thumbs = 'down') AS down, avg(rating) AS mean_rating, count(rating) AS rated, count(*)::DOUBLE / (SELECT count(*) FROM events) AS feedback_rate FROM ({FEEDBACK})", ("mean_rating", "feedback_rate"))
def feedback_stats(t):
    f = _feedback(t).agg(F.count("*").alias("total"), F.count_if(F.col("thumbs") == "up").alias("up"), F.count_if(F.col("thumbs") == "down").alias("down"), F.avg("rating").alias("mean_rating"), F.count("rating").alias("rated"))
    return f.join(t.events.agg(F.count("*").alias("_n"))).withColumn("feedback_rate", F.col("total") / F.col("_n")).drop("_n")


@query(f"SELECT issue, count(*) AS n, count(DISTINCT user_id) AS users FROM ({FEEDBACK}) WHERE thumbs = 'down' GROUP BY 1 ORDER BY 2 DESC, 1")
def issue_frequency(t):
    return _feedback(t).filter("thumbs = 'down'").groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).orderBy(F.desc("n"), "issue")


@query(f"SELECT id, thumbs, rating, ts FROM ({FEEDBACK}) WHERE thumbs = 'down' ORDER BY ts DESC, id LIMIT 50")
def worst_feedback(t):
    return _feedback(t).filter("thumbs = 'down'").select("id", "thumbs", "rating", "ts").orderBy(F.desc("ts"), "id").limit(50)


LOGS = "SELECT a.conv_id * 1000 + a.turn AS qid, a.conv_id, a.text AS query, b.text AS response, CASE WHEN (a.conv_id + a.turn) % 7 = 0 THEN NULL ELSE ((a.conv_id * 13 + a.turn * 7) % 100) / 100.0::DOUBLE END AS relevance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"


def _logs(t):
    c = t.conversations
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    rel = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit(None)).otherwise((F.col("conv_id") * 13 + F.col("turn") * 7) % 100 / 100.0)
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "query", "response", rel.alias("relevance"))


_UNC = f"""WITH q AS (SELECT l.qid, l.conv_id % 10 AS cluster, CASE WHEN relevance IS NULL OR relevance = 0 THEN 0.5 ELSE relevance END AS rel, f.thumbs, coalesce(f.rating, 3) AS rating FROM ({LOGS}) l LEFT JOIN ({FEEDBACK}) f ON f.id = l.qid WHERE f.id IS NULL OR f.processed = 0),
u AS (SELECT qid, cluster, (1 - (rel - min(rel) OVER ()) / (max(rel) OVER () - min(rel) OVER () + 1e-8)) * CASE WHEN thumbs = 'down' THEN 1.5 ELSE 1 END * CASE WHEN rating <= 2 THEN 1.3 ELSE 1 END AS uncertainty FROM q)
SELECT qid, cluster, round(uncertainty, 9) AS uncertainty FROM u"""


def _uncertain(t):
    q = _logs(t).join(_feedback(t).select(F.col("id").alias("qid"), "thumbs", "rating", "processed"), "qid", "left").filter("processed is null or processed = 0")
    q = q.withColumn("rel", F.when(F.col("relevance").isNull() | (F.col("relevance") == 0), 0.5).otherwise(F.col("relevance")))
    q = q.join(q.agg(F.min("rel").alias("lo"), F.max("rel").alias("hi")))
    u = (1 - (F.col("rel") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)) * F.when(F.col("thumbs") == "down", 1.5).otherwise(1.0) * F.when(F.coalesce("rating", F.lit(3)) <= 2, 1.3).otherwise(1.0)
    return q.select("qid", (F.col("conv_id") % 10).alias("cluster"), F.round(u, 9).alias("uncertainty"))


@query(_UNC, ("uncertainty",))
def uncertainty_scores(t):
    return _uncertain(t)


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY uncertainty DESC, qid) AS rn FROM ({_UNC}) x), p AS (SELECT *, CASE WHEN rn <= 3 THEN 'cluster' ELSE 'fill' END AS pick FROM r WHERE rn <= 50)
    SELECT qid, cluster, uncertainty, pick, CASE WHEN uncertainty > 0.7 THEN 'high' ELSE 'medium' END AS priority FROM p ORDER BY pick, uncertainty DESC, qid LIMIT 50""",
    ("uncertainty",),
)
def active_learning_select(t):
    return V.top_per_cluster(_uncertain(t), "cluster", "uncertainty", "qid", 3, 50).withColumn("priority", F.when(F.col("uncertainty") > 0.7, "high").otherwise("medium"))


_ERR = f"SELECT l.qid, f.thumbs, l.relevance FROM ({LOGS}) l LEFT JOIN ({FEEDBACK}) f ON f.id = l.qid WHERE f.thumbs = 'down' OR l.relevance < 0.5 OR l.relevance IS NULL ORDER BY CASE WHEN f.thumbs = 'down' THEN 0 ELSE 1 END, l.relevance ASC NULLS FIRST, l.qid LIMIT 20"


def _errors(t):
    j = _logs(t).join(_feedback(t).select(F.col("id").alias("qid"), "thumbs"), "qid", "left").filter("thumbs = 'down' or relevance < 0.5 or relevance is null")
    return j.orderBy(F.when(F.col("thumbs") == "down", 0).otherwise(1), F.col("relevance").asc_nulls_first(), "qid").limit(20).select("qid", "thumbs", "relevance")


@query(_ERR)
def error_selection(t):
    return _errors(t)


@query(f"(SELECT qid, 'uncertainty' AS strategy FROM ({_UNC}) ORDER BY uncertainty DESC, qid LIMIT 20) UNION ALL (SELECT qid, 'error' FROM ({_ERR})) UNION ALL (SELECT qid, 'random' FROM ({LOGS}) ORDER BY md5(concat(qid::VARCHAR, ':7')), qid LIMIT 10)")
def mixed_selection(t):
    """40 % uncertain, 40 % errors, 20 % random; what is chosen twice stays twice."""
    a = _uncertain(t).orderBy(F.desc("uncertainty"), "qid").limit(20).select("qid", F.lit("uncertainty").alias("strategy"))
    b = _errors(t).select("qid", F.lit("error").alias("strategy"))
    c = _logs(t).select("qid").orderBy(hashed_order(F.col("qid"), F.lit("7")), "qid").limit(10).select("qid", F.lit("random").alias("strategy"))
    return a.unionByName(b).unionByName(c)


def _ratings(t):
    return t.labels.select("doc_id", F.explode(F.array(F.col("quality"), 1 - F.col("toxic"))).alias("rating")).withColumnRenamed("doc_id", "unit")


_O = """WITH r AS (SELECT doc_id, unnest([quality, 1 - toxic]) AS rating FROM labels), k AS (SELECT doc_id, rating, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc_id) AS m FROM r WHERE rating IS NOT NULL GROUP BY 1, 2),
o AS (SELECT a.rating AS c, b.rating AS d, sum(a.k * (b.k - CASE WHEN a.rating = b.rating THEN 1 ELSE 0 END)::DOUBLE / (a.m - 1)) AS o FROM k a JOIN k b USING (doc_id) WHERE a.m >= 2 GROUP BY 1, 2), n AS (SELECT c, sum(o) AS n FROM o GROUP BY 1)
SELECT (SELECT count(DISTINCT doc_id) FROM k WHERE m >= 2) AS units, 1 - (sum(n.n) - 1) * (SELECT o FROM o WHERE c = 0 AND d = 1) / ((SELECT n FROM n WHERE c = 0) * (SELECT n FROM n WHERE c = 1)) AS alpha FROM n"""


@query(_O, ("alpha",))
def krippendorff_alpha(t):
    return V.ordinal_alpha(_ratings(t))


@query("SELECT doc_id, quality <> 1 - toxic AS disagree FROM labels")
def disagreements(t):
    r = _ratings(t).groupBy(F.col("unit").alias("doc_id")).agg(F.collect_set("rating").alias("s"))
    return r.select("doc_id", (F.array_contains("s", 0) & F.array_contains("s", 1)).alias("disagree"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) % 10 = 0 AS ask FROM events")
def feedback_prompt_every_n(t):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return t.events.select("event_id", (F.row_number().over(w) % 10 == 0).alias("ask"))


@query(f"SELECT * FROM ({FEEDBACK}) f WHERE EXISTS (SELECT 1 FROM ({LOGS}) l WHERE l.qid = f.id)")
def feedback_accepted(t):
    """Semi join: feedback on queries that exist."""
    return _feedback(t).join(_logs(t).select(F.col("qid").alias("id")), "id", "left_semi").withColumn("processed", F.col("processed"))


@query(f"SELECT l.qid, length(l.query) AS n_query, f.thumbs FROM ({LOGS}) l LEFT JOIN ({FEEDBACK}) f ON f.id = l.qid WHERE f.processed = 0 OR f.id IS NULL ORDER BY l.qid LIMIT 500")
def annotation_candidates(t):
    j = _logs(t).join(_feedback(t).select(F.col("id").alias("qid"), "thumbs", "processed"), "qid", "left").filter("processed = 0 or processed is null")
    return j.select("qid", F.length("query").cast("long").alias("n_query"), "thumbs").orderBy("qid").limit(500)


_RATED = f"SELECT l.conv_id, avg(l.relevance) AS auto, avg(f.rating) AS human FROM ({LOGS}) l LEFT JOIN ({FEEDBACK}) f ON f.id = l.qid GROUP BY 1"


@query(f"SELECT conv_id, 0.6 * coalesce(auto, 0.5) + 0.4 * coalesce((human - 1) / 4, 0.5) AS combined FROM ({_RATED})", ("combined",))
def combined_score(t):
    j = _logs(t).join(_feedback(t).select(F.col("id").alias("qid"), "rating"), "qid", "left").groupBy("conv_id").agg(F.avg("relevance").alias("a"), F.avg("rating").alias("h"))
    return j.select("conv_id", (0.6 * F.coalesce("a", F.lit(0.5)) + 0.4 * F.coalesce((F.col("h") - 1) / 4, F.lit(0.5))).alias("combined"))


# traces: a user's day is a trace, its events are spans
@query("SELECT event_type AS name, count(*) AS n, sum(value) AS total_ms, max(value) AS longest, quantile_cont(value, 0.95) AS p95, sum(value) / (SELECT sum(value) FROM events) AS share, count(*) FILTER (value > 40) AS n_slow FROM events GROUP BY 1", ("total_ms", "longest", "p95", "share"))
def span_rollup(t):
    s = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.sum("value").alias("total_ms"), F.max("value").alias("longest"), F.percentile("value", 0.95).alias("p95"), F.count_if(F.col("value") > 40).alias("n_slow"))
    return s.join(s.agg(F.sum("total_ms").alias("_t"))).withColumn("share", F.col("total_ms") / F.col("_t")).drop("_t")


@query("WITH s AS (SELECT concat(user_id::VARCHAR, '-', ts::DATE::VARCHAR) AS trace_id, bool_or(event_type = 'error') AS failed, sum(value) AS ms, count(*) AS spans FROM events GROUP BY 1) SELECT trace_id, spans FROM s WHERE failed OR round(ms, 6) > 100 OR concat('0x', substr(md5(trace_id), 1, 8))::UBIGINT::DOUBLE / 4294967296 < 0.1")
def tail_sampling(t):
    s = t.events.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("trace_id")).agg(F.bool_or(F.col("event_type") == "error").alias("failed"), F.sum("value").alias("ms"), F.count("*").alias("spans"))
    return s.filter(F.col("failed") | (F.round("ms", 6) > 100) | (unit_interval(F.col("trace_id")) < 0.1)).select("trace_id", "spans")


@query("SELECT event_id, '[REDACTED]' AS api_key, event_type AS kind, '[REDACTED]' AS user_ssn FROM events")
def attribute_redaction(t):
    m = F.create_map(F.lit("api_key"), F.concat(F.lit("k"), F.col("user_id").cast("string")), F.lit("kind"), F.col("event_type"), F.lit("user_SSN"), F.col("user_id").cast("string"))
    clean = F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("password|api_key|ssn|credit_card"), "[REDACTED]").otherwise(v))
    return t.events.select("event_id", clean.alias("m")).select("event_id", F.col("m")["api_key"].alias("api_key"), F.col("m")["kind"].alias("kind"), F.col("m")["user_SSN"].alias("user_ssn"))


@query("SELECT d.doc_id, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id % 13 <> 0 ORDER BY d.doc_id DESC LIMIT 100")
def left_join_profile(t):
    """Live documents with their vectors, newest first."""
    d = t.documents.filter("doc_id % 13 <> 0").select("doc_id")
    return d.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").orderBy(F.desc("doc_id")).limit(100)


@query("SELECT sum(value) / 7 * 30 * 0.001 AS monthly_cost, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27'", ("monthly_cost",))
def usage_projection(t):
    e = t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-20' AND ts < TIMESTAMP_NTZ '2024-01-27'")
    return e.agg((F.sum("value") / 7 * 30 * 0.001).alias("monthly_cost"), F.count("*").alias("n"))
