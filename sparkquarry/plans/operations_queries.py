"""Monitoring, lifecycle, queues, golden sets: events stand for samples, changes and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounding as R
from ..functions import text as T
from ..functions import vectors as VX
from ..operators import access as AC
from ..operators import experiments as X
from ..operators import lifecycle as L
from ..operators import monitoring as M
from ..operators import pii as P
from ..sources import golden as G
from ..sources import queues as Q
from .platform_queries import _COS, PERMS, _permissions
from .registry import query

_E = "epoch(date_trunc('second', ts))::BIGINT"


# exposition and buffers
@query("SELECT concat('events_total{event_type=\"', event_type, '\",outcome=\"', CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END, '\"} ', count(*)) AS line FROM events GROUP BY event_type")
def metrics_exposition(t):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("value")).withColumn("outcome", F.when(F.col("event_type") == "error", "failure").otherwise("success"))
    return M.exposition(n, "events_total", ["outcome", "event_type"])


_HIST = (1.0, 5.0, 10.0, 25.0, 50.0)
_HIST_LINES = " UNION ALL ".join(
    [f"SELECT event_type, {i} AS k, concat('event_value_bucket{{event_type=\"', event_type, '\",le=\"{b:g}\"}} ', count(*) FILTER (value <= {b})) AS line FROM e GROUP BY event_type" for i, b in enumerate(_HIST)]
    + [
        f"SELECT event_type, {len(_HIST)}, concat('event_value_bucket{{event_type=\"', event_type, '\",le=\"+Inf\"}} ', count(*)) FROM e GROUP BY event_type",
        f"SELECT event_type, {len(_HIST) + 1}, concat('event_value_sum{{event_type=\"', event_type, '\"}} ', sum(value::DECIMAL(38, 6))) FROM e GROUP BY event_type",
        f"SELECT event_type, {len(_HIST) + 2}, concat('event_value_count{{event_type=\"', event_type, '\"}} ', count(*)) FROM e GROUP BY event_type",
    ]
)


@query(f"WITH e AS (SELECT * FROM events WHERE value IS NOT NULL), l AS ({_HIST_LINES}) SELECT 1 AS position, '# HELP event_value Values of events' AS line UNION ALL SELECT 2, '# TYPE event_value histogram' UNION ALL SELECT row_number() OVER (ORDER BY event_type, k) + 2, line FROM l")
def histogram_exposition(t):
    return M.histogram_exposition(t.events, "event_value", "Values of events", ["event_type"], _HIST)


@query("SELECT event_type, to_timestamp(floor(epoch(ts) / 60) * 60)::TIMESTAMP AS flushed, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1, 2", ("mean",))
def buffered_means(t):
    return M.buffered_means(t.events, ["event_type"])


@query("WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n, count(*) FILTER (value > 40) AS slow FROM events GROUP BY 1, 2) SELECT event_type, day, slow / n AS ratio FROM d WHERE n <> 0", ("ratio",))
def series_ratio(t):
    """Slow events beside all, as two series that agree in type and day."""
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day"))
    return M.divided(d.agg(F.count_if(F.col("value") > 40).cast("double").alias("value")), d.agg(F.count("*").alias("value")), ["event_type", "day"])


# drift
def _drift(t):
    d = t.documents.select((F.col("doc_id") % 5).alias("batch"), (F.col("doc_id") % 2 == 0).cast("int").alias("sample"), F.length("text").cast("double").alias("chunk_length"), T.density_score(F.col("text")).alias("information_density"))
    d = d.withColumn("quality_score", F.col("information_density") * 0.5 + F.least(F.col("chunk_length"), F.lit(1000.0)) / 20)
    long = d.unpivot(["batch", "sample"], ["quality_score", "chunk_length", "information_density"], "metric", "v")
    tests = X.ks_two_sample(long, ["batch", "metric"], "sample", "v")
    means = long.groupBy("batch", "metric").agg(F.avg(F.when(F.col("sample") == 0, F.col("v"))).alias("baseline"), F.avg(F.when(F.col("sample") == 1, F.col("v"))).alias("current"))
    return M.drift_verdicts(tests, means)


@query()
def drift_verdict(t):
    """Kolmogorov-Smirnov over quality, length and density of each batch, with what to look at."""
    return _drift(t)


_ROLL = """WITH last AS (SELECT max(ts)::DATE AS d FROM events), r AS (SELECT event_type, (ts::DATE + a)::DATE AS batch, (a = 0)::INT AS sample, value AS v FROM events, (SELECT unnest(range(8))::INT AS a) WHERE ts::DATE + a <= (SELECT d FROM last) AND value IS NOT NULL),
c AS (SELECT event_type, batch, v, sum(sample) AS k1, count(*) - sum(sample) AS k0 FROM r GROUP BY 1, 2, 3),
s AS (SELECT event_type, batch, sum(k0) OVER (PARTITION BY event_type, batch ORDER BY v) AS c0, sum(k1) OVER (PARTITION BY event_type, batch ORDER BY v) AS c1, sum(k0) OVER (PARTITION BY event_type, batch) AS n0, sum(k1) OVER (PARTITION BY event_type, batch) AS n1 FROM c)
SELECT event_type, batch, max(abs(c0 / n0 - c1 / n1)) AS statistic FROM s WHERE n0 > 0 AND n1 > 0 GROUP BY 1, 2"""


@query(_ROLL, ("statistic",))
def rolling_drift(t):
    """Each day's values against those of the seven days before."""
    e = t.events.filter("value is not null").select("event_type", F.to_date("ts").alias("day"), F.col("value").alias("v"))
    tests = X.ks_two_sample(M.rolling_samples(e, "day"), ["event_type", "batch"], "sample", "v")
    return tests.filter("statistic is not null").select("event_type", "batch", "statistic")


# alerts and plans
_NAME = "CASE event_id % 3 WHEN 0 THEN 'QueryTimeout' WHEN 1 THEN 'DiskSpaceLow' ELSE 'HighMemoryUsage' END"


def _named(t):
    k = F.col("event_id") % 3
    return t.events.filter("value > 10").select("event_id", "ts", F.when(k == 0, "QueryTimeout").when(k == 1, "DiskSpaceLow").otherwise("HighMemoryUsage").alias("alertname"))


@query(
    f"""WITH a AS (SELECT {_NAME} AS alertname, {_E} AS s0, ts::DATE AS day FROM events WHERE value > 10), f AS (SELECT *, min(s0) OVER (PARTITION BY alertname, day) AS f0 FROM a),
    s AS (SELECT *, CASE WHEN s0 - f0 <= 30 THEN 0 ELSE ceil((s0 - f0 - 30) / 300)::BIGINT END AS slot FROM f)
    SELECT alertname, slot, make_timestamp((f0 + 30 + slot * 300) * 1000000) AS sent, count(*) AS n_alerts FROM s GROUP BY 1, 2, 3"""
)
def alert_routing(t):
    return M.routed(_named(t), ["alertname"])


@query(f"SELECT alertname, make_timestamp(unnest(range(a, greatest(a, b) + 1, 14400)) * 1000000) AS sent FROM (SELECT {_NAME} AS alertname, min({_E}) AS a, max({_E}) AS b FROM events WHERE value > 10 GROUP BY 1, ts::DATE)")
def alert_repeats(t):
    firing = _named(t).groupBy("alertname", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"))
    return M.repeats(firing, ["alertname"])


_PLAN = "CASE WHEN event_id % 4 = 0 THEN 'Seq Scan on chunks' WHEN event_id % 4 = 1 THEN 'Hash Join on Large_table' ELSE 'Index Scan' END || ' (actual time=0.1..' || (event_id * 7 % 3000) || '.5 rows=1)'"


@query(f"SELECT event_id, array_to_string(list_filter([CASE WHEN contains(p, 'Seq Scan') THEN 'sequential_scan' END, CASE WHEN contains(p, 'Hash Join') AND contains(lower(p), 'large') THEN 'large_hash_join' END, CASE WHEN regexp_extract(p, 'actual time=[0-9.]+\\.\\.([0-9.]+)', 1)::DOUBLE > 1000 THEN 'slow_execution' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT event_id, {_PLAN} AS p FROM events)")
def plan_issues(t):
    k = F.col("event_id") % 4
    p = F.concat(F.when(k == 0, "Seq Scan on chunks").when(k == 1, "Hash Join on Large_table").otherwise("Index Scan"), F.lit(" (actual time=0.1.."), (F.col("event_id") * 7 % 3000).cast("string"), F.lit(".5 rows=1)"))
    return t.events.select("event_id", F.array_join(M.plan_issues(p), ",").alias("issues"))


# time ranges, classes, flags
@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= date_trunc('day', TIMESTAMP '2024-01-25 13:00:00' - INTERVAL 7 DAY) AND ts <= TIMESTAMP '2024-01-25 13:00:00' GROUP BY 1")
def recent_days(t):
    return t.events.filter(L.days_back(F.col("ts"), F.lit("2024-01-25 13:00:00").cast("timestamp_ntz"), 7)).groupBy("user_id").agg(F.count("*").alias("n"))


_ANY = " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for _, p, _ in P.PATTERNS)


@query(f"SELECT doc_id, CASE WHEN {_ANY} THEN 'confidential' ELSE 'internal' END AS level FROM documents")
def pii_access_level(t):
    """Documents with personal data of any kind are confidential."""
    found = P.detect(t.documents).select("doc_id").distinct().withColumn("level", F.lit("confidential"))
    return t.documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("level", F.lit("internal")).alias("level"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN true ELSE length(text) BETWEEN 200 AND 5000 END AS accepted FROM documents")
def kill_switch(t):
    """Where the switch of a tenant is off, the check is bypassed."""
    off = F.col("doc_id") % 10 == 0
    return t.documents.select("doc_id", (off | F.length("text").between(200, 5000)).alias("accepted"))


# keys, maps, assignments
@query("SELECT doc_id, concat(source, '/', doc_id, '_chunk_', i) AS chunk_key FROM (SELECT doc_id, source, unnest(range(1 + doc_id % 3)) AS i FROM documents)")
def chunk_keys(t):
    i = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("i")
    return t.documents.select("doc_id", "source", i).select("doc_id", F.format_string("%s/%d_chunk_%d", "source", "doc_id", "i").alias("chunk_key"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'override' ELSE source END AS source, lang, CASE WHEN doc_id % 3 = 0 THEN 'v2' END AS version FROM documents")
def metadata_merge(t):
    """New entries replace those of the same name."""
    new = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("source"), F.lit("override"), F.lit("version"), F.lit("v2"))).otherwise(F.create_map().cast("map<string,string>"))
    old = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    kept = F.map_filter("old", lambda k, v: ~F.map_contains_key("new", k))
    m = t.documents.select("doc_id", old.alias("old"), new.alias("new")).select("doc_id", F.map_concat(kept, F.col("new")).alias("m"))
    return m.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("source", "lang", "version")])


@query("SELECT user_id, CASE user_id % 2 WHEN 0 THEN 'control' ELSE 'treatment' END AS variant FROM (SELECT DISTINCT user_id FROM events)")
def biased_assignment(t):
    """Parity of the number in a user's name: kept as the anti-pattern that it is, beside variant_assignment."""
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    number = F.element_at(F.split(name, "_"), -1).cast("long")
    return t.events.select("user_id").distinct().select("user_id", F.when(F.pmod(number, F.lit(2)) == 0, "control").otherwise("treatment").alias("variant"))


# experiments, roles, retention
_XE = "SELECT event_id % 40 AS experiment_id, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id) = 1 THEN 'create' WHEN event_type = 'purchase' THEN 'stop' ELSE 'update' END AS action, (event_id % 100) / 100.0::DOUBLE AS split, ts AS happened FROM events"


@query(f"WITH e AS ({_XE}) SELECT experiment_id, CASE WHEN max_by(action, seq) = 'stop' THEN 'stopped' ELSE 'running' END AS status, max_by(split, seq) FILTER (action <> 'stop') AS split, CASE WHEN max_by(action, seq) = 'stop' THEN max_by(happened, seq) END AS stopped_at, count(*) FILTER (action = 'update') AS updates FROM e GROUP BY 1")
def experiment_state(t):
    e = t.events.select((F.col("event_id") % 40).alias("experiment_id"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") % 100 / F.lit(100.0)).alias("split"), F.col("ts").alias("at"))
    first = e.groupBy("experiment_id").agg(F.min("seq").alias("first"))
    action = F.when(F.col("seq") == F.col("first"), "create").when(F.col("event_type") == "purchase", "stop").otherwise("update")
    return L.experiment_state(e.join(first, "experiment_id").withColumn("action", action))


_RE = "SELECT user_id, ['viewer', 'editor', 'admin'][1 + event_id % 3] AS role, event_id AS seq, CASE WHEN event_type = 'error' THEN 'revoke' ELSE 'assign' END AS action FROM events"


@query(f"WITH e AS ({_RE}), l AS (SELECT user_id, role, max_by(action, seq) AS a FROM e GROUP BY 1, 2), v AS (SELECT user_id, count(*) AS version FROM e GROUP BY 1) SELECT user_id, role, version FROM l JOIN v USING (user_id) WHERE a = 'assign'")
def role_assignments(t):
    role = F.get(F.array(F.lit("viewer"), F.lit("editor"), F.lit("admin")), (F.col("event_id") % 3).cast("int"))
    return L.role_state(t.events.select("user_id", role.alias("role"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "revoke").otherwise("assign").alias("action")))


@query(f"WITH q AS (SELECT event_id, ['viewer', 'editor', 'admin'][1 + user_id % 3] AS role, unnest(['public', 'internal', 'confidential']) AS resource, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS action FROM events) SELECT event_id, q.role, q.resource, q.action, p.role IS NOT NULL AS granted FROM q LEFT JOIN ({PERMS}) p ON p.role = q.role AND p.resource = q.resource AND p.action = q.action")
def permission_checks(t):
    """Three checks for each request for accessible levels, each logged."""
    role = F.get(F.array(F.lit("viewer"), F.lit("editor"), F.lit("admin")), (F.col("user_id") % 3).cast("int"))
    q = t.events.select("event_id", role.alias("role"), F.explode(F.array(F.lit("public"), F.lit("internal"), F.lit("confidential"))).alias("resource"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("action"))
    return L.check_log(q, _permissions(t)).select("event_id", "role", "resource", "action", "granted")


@query("SELECT label, replaced_at, active, CASE WHEN replaced_at IS NOT NULL THEN replaced_at + INTERVAL 48 HOUR END AS delete_at, coalesce(replaced_at + INTERVAL 48 HOUR <= TIMESTAMP '2024-01-10 00:00:00' AND NOT active, false) AS drop FROM (SELECT label, CASE WHEN label % 5 <> 0 THEN TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 12 HOUR * label END AS replaced_at, label % 4 = 0 AS active FROM (SELECT DISTINCT label FROM embeddings))")
def index_retention(t):
    """Replaced indexes stay two days; the active one always stays."""
    at = (F.lit("2024-01-05 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("label") * 12).cast("int"))).cast("timestamp_ntz")
    copies = t.embeddings.select("label").distinct().withColumn("replaced_at", F.when(F.col("label") % 5 != 0, at)).withColumn("active", F.col("label") % 4 == 0)
    return L.retention(copies, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit(48))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def verified_delete(t):
    e = t.embeddings.select("vec_id")
    return L.delete_verified(e, e.filter("vec_id % 7 = 0"), ["vec_id"], e.filter("vec_id % 7 <> 0"))


# prompts and golden sets
_ISSUES = "[" + ", ".join(f"'{k}'" for k in L.PROMPT_FIXES) + "]"
_FIX = "CASE issue " + " ".join(f"WHEN '{k}' THEN concat(chr(10), chr(10), '{v.strip()}')" for k, v in L.PROMPT_FIXES.items()) + " ELSE '' END"


@query(f"WITH i AS (SELECT {_ISSUES}[1 + event_id % 5] AS issue, count(*) AS n FROM events WHERE value < 10 GROUP BY 1), top AS (SELECT issue FROM i ORDER BY n DESC, issue LIMIT 1) SELECT 4 AS id, concat('Prompt 3', {_FIX}) AS system_prompt FROM top")
def prompt_update(t):
    issue = F.get(F.array(*map(F.lit, L.PROMPT_FIXES)), (F.col("event_id") % 5).cast("int"))
    versions = t.spark.createDataFrame([(1, "Prompt 1"), (3, "Prompt 3"), (2, "Prompt 2")], "id int, system_prompt string")
    return L.next_prompt(versions, t.events.filter("value < 10").select(issue.alias("issue")))


@query("SELECT event_id, improvement FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN concat('better ', event_id) ELSE '' END AS improvement FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 10) WHERE improvement <> ''")
def golden_additions(t):
    r = t.events.filter("value is not null").select("event_id", "value", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("better "), F.col("event_id").cast("string"))).otherwise("").alias("improvement"))
    return L.golden_additions(r, [F.col("value"), F.col("event_id")]).select("event_id", "improvement")


@query("SELECT conv_id, turn, concat(conv_id, '/', turn, ': ', text) AS question, 'v1' AS version FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def golden_round_trip(t):
    """A golden set saved under a name and a version and loaded again; it may not hold a question twice."""
    from ..sources.shared import shared_path

    root = shared_path(t.spark, "golden")
    items = t.conversations.filter("role = 'user' and text is not null").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(": "), F.col("text")).alias("question"))
    G.save(items, root, "support", "v1")
    return G.load(t.spark, root, "support", "v1", "conv_id long, turn long, question string").withColumn("version", F.lit("v1"))


@query("SELECT count(*) AS runs, max(n) AS most_of_one, count(*) FILTER (n > 1) AS repeated FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def duplicate_questions(t):
    n = t.documents.groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("runs"), F.max("n").alias("most_of_one"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("SELECT event_type, event_id AS run_id, ts AS start_time, value AS score FROM events ORDER BY ts DESC, event_id LIMIT 10")
def latest_runs(t):
    """Evaluation runs, the latest ten."""
    return t.events.select("event_type", F.col("event_id").alias("run_id"), F.col("ts").alias("start_time"), F.col("value").alias("score")).orderBy(F.desc("start_time"), "run_id").limit(10)


# retrieval
_ALL = f"SELECT a.vec_id AS query_id, b.vec_id AS match_id, round({_COS}, 6) AS first_score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) <= 10"
_DEEP = "round(first_score * 0.7 + 0.3 / (1 + abs(match_id - query_id) % 100), 6)"


@query(f"SELECT query_id, match_id, score, place FROM (SELECT *, {_DEEP} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_DEEP} DESC, match_id) AS place FROM ({_ALL})) WHERE place <= 5")
def rerank_topk(t):
    """Ten candidates by cosine, five of them by a second score, any column."""
    from .platform_queries import _candidates

    s = _candidates(t, 10).withColumnRenamed("score", "first_score")
    deep = F.round(F.col("first_score") * 0.7 + F.lit(0.3) / (1 + F.abs(F.col("match_id") - F.col("query_id")) % 100), 6)
    return L.reranked(s, "query_id", deep, "match_id").select("query_id", "match_id", "score", "place")


@query("SELECT count(*) AS n, avg(s) AS average_similarity, avg((round(s, 9) > 0.75)::INT) AS pass_rate FROM (SELECT " + _COS + " AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)", ("average_similarity", "pass_rate"))
def similarity_evaluation(t):
    """Each vector as an answer, the next as what was expected."""
    e = t.embeddings.select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("expected"))
    return L.cosine_report(e.join(nxt, "vec_id").select(F.round(VX.cosine(F.col("embedding"), F.col("expected")), 9).alias("similarity")))


@query("SELECT page, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS page FROM embeddings) GROUP BY 1")
def vector_pages(t):
    """Ids in pages of a hundred, numbered through counts of ranges of ids, so that no task sees all of them."""
    from pyspark.sql import Window

    e = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 4096).alias("cell"))
    n = e.groupBy("cell").agg(F.count("*").alias("n"))
    before = n.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("vec_id")) + F.col("before") - 1
    return e.join(before, "cell").select("vec_id", F.floor(nth / 100).alias("page")).groupBy("page").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


_CH = "SELECT doc_id, i, i * 80 AS a, i * 80 + 80 + (doc_id * 7 + i * 13) % 60 AS b FROM (SELECT doc_id, unnest(range(6)) AS i FROM documents)"


@query(f"SELECT doc_id, i FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_CH})) WHERE reach IS NULL OR reach <= a")
def chunk_overlaps(t):
    """Chunks that overlap none before them, by one ordered pass instead of all pairs."""
    c = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("i"))
    c = c.withColumn("a", F.col("i") * 80).withColumn("b", F.col("a") + 80 + (F.col("doc_id") * 7 + F.col("i") * 13) % 60)
    return L.without_overlaps(c, "doc_id", "i", "a", "b").select("doc_id", "i")


# queues
@query("SELECT event_id, user_id, event_type FROM events WHERE value > 30")
def queue_consumer(t):
    """Web hook calls in a queue folder, consumed in batches; a message that comes twice is stored once."""
    from ..sources.shared import shared_path

    path, out = shared_path(t.spark, "queue"), shared_path(t.spark, "consumed")
    calls = t.events.filter("value > 30").select("event_id", "user_id", "event_type")
    Q.enqueue(calls, path)
    Q.enqueue(calls.filter("event_id % 10 = 0"), path)
    stream = Q.queue(t.spark, path, "event_id long, user_id long, event_type string", files=4)
    Q.consume(stream, lambda batch, n: batch.filter("_corrupt is null").drop("_corrupt").write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{out}-checkpoint")
    return t.spark.read.parquet(out).drop("batch").dropDuplicates(["event_id"])


# offsets of personal data
_AT = "length(split_part(text, m, 1))"


@query("SELECT doc_id, 'EMAIL_ADDRESS' AS entity, strpos(text, m) - 1 AS start_at, strpos(text, m) - 1 + length(m) AS end_at FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS m FROM documents) WHERE m <> ''")
def pii_first_email(t):
    """Where each document's first address stands, code points, end exclusive."""
    found = P.spans(t.documents, entities=("EMAIL_ADDRESS",))
    return found.groupBy("doc_id", "entity").agg(F.min(F.struct("start_at", "end_at")).alias("s")).select("doc_id", "entity", "s.*")


_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, '{e}' AS entity, {s}::DOUBLE AS score, unnest(string_split_regex(text, '{p}')) AS gap, unnest(list_append(regexp_extract_all(text, '{p}'), NULL)) AS match, unnest(range(len(regexp_extract_all(text, '{p}')) + 1)) AS i, {k} AS k FROM documents"
    for k, (e, p, s) in enumerate(P.PATTERNS)
)


@query(f"SELECT doc_id, entity, (upto - length(match))::BIGINT AS start_at, upto::BIGINT AS end_at, score, match FROM (SELECT *, sum(length(gap) + coalesce(length(match), 0)) OVER (PARTITION BY doc_id, k ORDER BY i) AS upto FROM ({_SPANS})) WHERE match IS NOT NULL")
def pii_spans(t):
    """Every entity with its place, code points, end exclusive."""
    return P.spans(t.documents)


def _registered(t):
    from ..functions.udfs import register

    register(t.spark)
    t.documents.createOrReplaceTempView("documents_for_functions")
    return t.spark


@query("SELECT lang, count(*) AS n, sum((length(text) > 1000)::INT)::BIGINT AS long FROM documents GROUP BY 1")
def sql_functions(t):
    """An expression registered for SQL."""
    return _registered(t).sql("SELECT lang, count(*) AS n, sum(CAST(n_characters(text) > 1000 AS INT)) AS long FROM documents_for_functions GROUP BY lang")


@query("SELECT event_type, fsum(value) AS total FROM events GROUP BY 1", ("total",))
def sql_aggregate(t):
    """A typed aggregate registered for SQL: partial sums of 64 parts of a group, then their exact total."""
    _registered(t)
    t.events.createOrReplaceTempView("events_for_functions")
    return t.spark.sql(
        """SELECT event_type, exact_total(collect_list(part)) AS total FROM (
          SELECT event_type, exact_partial(value) AS part FROM events_for_functions GROUP BY event_type, pmod(event_id, 64)) GROUP BY event_type"""
    )


@query("SELECT doc_id, count(*) AS n_parts, max(length(p)) AS longest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ',')) AS p FROM documents) GROUP BY doc_id")
def sql_table_function(t):
    """A table function registered for SQL, joined laterally."""
    return _registered(t).sql("SELECT doc_id, count(*) AS n_parts, max(length(part)) AS longest FROM documents_for_functions, LATERAL parts(text) GROUP BY doc_id")


_ROUNDED = "floor(value * 8) / 8"


@query(f"SELECT event_id, printf('%.2f', {_ROUNDED})::DOUBLE AS of_eighths, printf('%.1f', value / 3)::DOUBLE AS one_place, printf('%.2f', value + 0.005)::DOUBLE AS near_ties, printf('%.0f', floor(value) + 0.5)::DOUBLE AS halves FROM events")
def python_rounding(t):
    """Doubles rounded by their exact value, ties to even."""
    v = F.col("value")
    return t.events.select("event_id", R.round_half_even(F.floor(v * 8) / 8).alias("of_eighths"), R.round_half_even(v / 3, 1).alias("one_place"), R.round_half_even(v + 0.005).alias("near_ties"), R.round_half_even(F.floor(v) + 0.5, 0).alias("halves"))


# requests and filters
@query("SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_custkey END AS user_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def api_key_lookup(t):
    """Whose key a request carries: users are known by the hash of their key, and only active ones count."""
    key = lambda c: F.concat(F.lit("key-"), F.col(c).cast("string"))
    users = t.customer.select(F.sha2(key("c_custkey"), 256).alias("key_hash"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("active"))
    return AC.key_owners(t.orders.select("o_orderkey", key("o_custkey").alias("key")), users, "key", "key_hash", "active")


@query("SELECT doc_id, lang FROM documents WHERE ['public', 'internal', 'confidential'][1 + doc_id % 3] IN ('public', 'internal') AND lang IN ('en', 'de') AND source = 'src1'")
def secured_filter(t):
    """A caller who asks for all levels sees those that the server allows."""
    level = F.get(F.array(F.lit("public"), F.lit("internal"), F.lit("confidential")), (F.col("doc_id") % 3).cast("int"))
    client = {"$and": [{"level": {"$in": ["public", "internal", "confidential"]}}, {"lang": {"$in": ["en", "de"]}}], "source": {"$eq": "src1"}}
    return AC.secured(t.documents.withColumn("level", level), {"level": {"$in": ["public", "internal"]}}, client).select("doc_id", "lang")


_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents"


@query(f"SELECT l.doc_id, l.chunk_index, d.n IS NOT NULL AS has_pii, coalesce(d.n, 0) AS pii_count, coalesce(d.types, '') AS pii_types FROM ({_LINES}) l LEFT JOIN (SELECT doc_id, count(match) AS n, string_agg(DISTINCT entity, ',' ORDER BY entity) AS types FROM ({_SPANS}) WHERE match IS NOT NULL GROUP BY 1) d USING (doc_id)")
def chunk_pii_flags(t):
    """Each line of a document carries what was found in the whole of it."""
    found = P.detect(t.documents).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("types"))
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))
    return lines.join(found, "doc_id", "left").select("doc_id", "chunk_index", F.col("n").isNotNull().alias("has_pii"), F.coalesce("n", F.lit(0)).alias("pii_count"), F.coalesce("types", F.lit("")).alias("pii_types"))


# counts, samples, latest
@query("SELECT ts::DATE AS day, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, coalesce(avg(value) FILTER (event_type <> 'error'), 0) AS mean_duration, count(DISTINCT user_id) AS documents FROM events GROUP BY 1", ("mean_duration",))
def pipeline_metrics(t):
    """Runs of a day: successes, failures, mean duration of the successful ones (0 if there were none), documents touched."""
    good = F.col("event_type") != "error"
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.avg(F.when(good, F.col("value"))), F.lit(0.0)).alias("mean_duration"), F.count_distinct("user_id").alias("documents"))


@query("SELECT count(DISTINCT label) AS clusters, count(DISTINCT conv_id) AS queries, count(DISTINCT role) AS annotators FROM (SELECT label, NULL AS conv_id, NULL AS role FROM embeddings UNION ALL SELECT NULL, conv_id, role FROM conversations)")
def coverage_counts(t):
    """Clusters, queries and annotators that are covered."""
    e = t.embeddings.agg(F.count_distinct("label").alias("clusters"))
    return e.join(t.conversations.agg(F.count_distinct("conv_id").alias("queries"), F.count_distinct("role").alias("annotators")))


@query("SELECT event_id, user_id FROM events ORDER BY md5(concat(event_id, '-review-7')), event_id LIMIT 50")
def review_sample(t):
    """Fifty rows at random: the first by a seeded hash, the same whenever it is drawn."""
    return t.events.orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("-review-7"))), "event_id").limit(50).select("event_id", "user_id")


@query("SELECT event_type, max_by(props, (ts, event_id)) AS config, max(ts) AS set_at FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def config_before_rollout(t):
    """Each variant's newest configuration from before the rollout, to go back to."""
    return t.events.filter("ts < timestamp_ntz'2024-01-15 00:00:00'").groupBy("event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("config"), F.max("ts").alias("set_at"))


@query("SELECT d.doc_id, e.label, c.c_name FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN customer c ON c.c_custkey = d.doc_id AND c.c_acctbal > 0 ORDER BY d.doc_id DESC LIMIT 10")
def newest_with_owner(t):
    """Documents that have a vector, newest first, with their owner if there is one."""
    owner = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"), "c_name")
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(owner, "doc_id", "left").orderBy(F.desc("doc_id")).limit(10).select("doc_id", "label", "c_name")
