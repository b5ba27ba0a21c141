"""Index, vectors, access and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as VX
from ..functions.hashing import anonymous_id
from ..operators import access as AC
from ..operators import audit as AU
from ..operators import index as IX
from ..operators import vector_index as VI
from .registry import query

CUR = "SELECT doc_id, sha256(text) AS hash, doc_id % 5 AS mtime FROM documents WHERE doc_id % 13 <> 0"
PREV = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(concat(text, 'x')) ELSE sha256(text) END AS hash, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 5 END AS mtime FROM documents WHERE doc_id % 11 <> 0"
STATUS = "SELECT coalesce(c.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'deleted' WHEN {same} THEN 'unchanged' ELSE 'modified' END AS status FROM (" + CUR + ") c FULL JOIN (" + PREV + ") p ON c.doc_id = p.doc_id"


def _current(t):
    return t.documents.filter("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 5).alias("mtime"))


def _previous(t):
    h = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return t.documents.filter("doc_id % 11 <> 0").select("doc_id", h.alias("hash"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("doc_id") % 5).alias("mtime"))


@query(STATUS.format(same="c.hash = p.hash"))
def change_detection(t):
    return IX.changes(_current(t), _previous(t))


@query(STATUS.format(same="c.mtime = p.mtime OR c.hash = p.hash"))
def mtime_change_detection(t):
    return IX.changes(_current(t), _previous(t), mtime="mtime")


@query(f"SELECT status, count(*) AS n FROM ({STATUS.format(same='c.hash = p.hash')}) GROUP BY 1")
def change_summary(t):
    return change_detection(t).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH s AS ({STATUS.format(same='c.hash = p.hash')}) SELECT doc_id, 'state' AS goes_to FROM s WHERE status = 'unchanged' OR (status <> 'deleted' AND NOT (doc_id % 17 = 0 AND status = 'new')) UNION ALL SELECT doc_id, 'retry' FROM s WHERE status IN ('new', 'modified') AND doc_id % 17 = 0")
def transactional_commit(t):
    """Only successes enter the state; failures stay as they were and are retried."""
    state, retry = IX.run_pipeline(_current(t).drop("mtime"), _previous(t).drop("mtime"), t.documents.filter("doc_id % 17 = 0").select("doc_id"))
    return state.select("doc_id", F.lit("state").alias("goes_to")).unionByName(retry.select("doc_id", F.lit("retry").alias("goes_to")))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 100 + label ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 100 + label FROM embeddings WHERE vec_id % 9 = 0")
def upsert_merge(t):
    e = t.embeddings.select("vec_id", "label")
    fresh = e.filter("vec_id % 4 = 0").unionByName(e.filter("vec_id % 9 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return IX.upsert(e, fresh.withColumn("label", F.col("label") + 100), ["vec_id"])


@query("SELECT doc_id, unnest(range(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 3 END)) AS chunk, doc_id % 7 = 0 AS fresh FROM documents")
def replace_document(t):
    old = t.documents.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>")).alias("chunk"), F.lit(False).alias("fresh"))
    new = t.documents.filter("doc_id % 7 = 0").select("doc_id", F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("fresh"))
    return IX.replace_documents(old, new)


@query("SELECT doc_id, doc_id % 13 = 0 AS deleted, CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at FROM documents")
def soft_delete(t):
    return IX.soft_delete(t.documents.select("doc_id"), F.col("doc_id") % 13 == 0, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


_LOG = "SELECT vec_id, version, (vec_id + version) % 11 = 0 AS deleted FROM embeddings, (SELECT unnest(range(1, 13)) AS version) v WHERE vec_id % (version + 1) = 0"


def _log(t):
    v = t.embeddings.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>")).alias("version"))
    return v.filter("vec_id % (version + 1) = 0").withColumn("deleted", (F.col("vec_id") + F.col("version")) % 11 == 0)


@query(f"SELECT version, count(*) AS n FROM ({_LOG}) GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def version_prune(t):
    return IX.latest_versions(_log(t).groupBy("version").agg(F.count("*").alias("n")), 10)


@query(f"SELECT vec_id, version FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS rn FROM ({_LOG}) WHERE version <= 6) WHERE rn = 1 AND NOT deleted")
def version_rollback(t):
    return IX.at_version(_log(t), ["vec_id"], 6).select("vec_id", "version")


@query("SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN 'missing' WHEN vec_id % 23 = 0 THEN 'dimension' ELSE 'none' END AS problem FROM embeddings")
def migration_verify(t):
    e = t.embeddings.select("vec_id", "embedding")
    target = e.filter("vec_id % 19 <> 0").withColumn("embedding", F.when(F.col("vec_id") % 23 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return IX.verify_copy(e, target, "vec_id", "embedding")


@query("SELECT n_blue, n_green, n_green::DOUBLE / n_blue AS ratio, CASE WHEN n_green::DOUBLE / n_blue >= 0.9 THEN 'green' ELSE 'blue' END AS active FROM (SELECT count(*) AS n_blue, count(*) FILTER (vec_id % 19 <> 0) AS n_green FROM embeddings)", ("ratio",))
def blue_green_gate(t):
    return IX.switch_gate(t.embeddings, t.embeddings.filter("vec_id % 19 <> 0"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0)")
def orphan_vectors(t):
    return IX.delete(t.embeddings.select("vec_id"), t.documents.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("vec_id")), ["vec_id"])


@query("SELECT label, count(*) AS n, max(len(embedding)) AS dim, count(*) * max(len(embedding)) * 4 * 1.2 / 1024 ^ 3 AS gb, count(*) * max(len(embedding)) * 4 * 1.2 / 1024 ^ 3 * 0.3 AS dollars FROM embeddings GROUP BY 1", ("gb", "dollars"))
def storage_cost(t):
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))
    gb, dollars = IX.storage_cost(F.col("n"), F.col("dim"))
    return n.withColumns({"gb": gb, "dollars": dollars})


_GB = "count(*) * max(len(embedding)) * 4 * 1.2 / 1024 ^ 3"


@query(f"SELECT label, r_name AS strategy, gb / 5 * ((30 * (r_regionkey + 1))::DOUBLE / (1 + 3 * r_regionkey)) * 0.023 * 1e6 AS micro_dollars, (row_number() OVER (PARTITION BY label ORDER BY (r_regionkey + 1)::DOUBLE / (1 + 3 * r_regionkey), r_name))::INT AS place FROM (SELECT label, {_GB} AS gb FROM embeddings GROUP BY 1) CROSS JOIN region", ("micro_dollars",))
def strategy_compare(t):
    """The grid of namespaces and backup strategies, cheapest first; a strategy (as many as regions) has its interval and retention from the region's key."""
    days = t.region.select(F.struct((F.col("r_regionkey") * 3 + 1).alias("every"), (30 * (F.col("r_regionkey") + 1)).alias("kept"), F.col("r_name").alias("strategy")).alias("s"))
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))
    # a strategy is a few numbers: their list goes to each namespace
    grid = n.join(days.agg(F.collect_list("s").alias("all"))).select("label", "n", "dim", F.explode("all").alias("s"))
    gb, _ = IX.storage_cost(F.col("n"), F.col("dim"))
    cost = grid.select("label", "s.strategy", (IX.backup_cost(gb, F.col("s.every"), F.col("s.kept")) * 1e6).alias("micro_dollars"), (F.col("s.kept") / 30 / F.col("s.every")).alias("_factor"))
    return cost.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("_factor", "strategy"))).drop("_factor")


@query("SELECT vec_id, len(embedding) <> 64 AS wrong_dim, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 AS is_zero FROM embeddings", ("norm",))
def embedding_validate(t):
    n = VX.norm(F.col("embedding"))
    return t.embeddings.select("vec_id", (F.size("embedding") != 64).alias("wrong_dim"), n.alias("norm"), (n == 0).alias("is_zero"))


@query("SELECT vec_id, embedding[1:32] AS embedding FROM embeddings")
def dimension_truncate(t):
    return t.embeddings.select("vec_id", VX.truncated(F.col("embedding"), 32).alias("embedding"))


@query()
def laplace_noise(t):
    return t.embeddings.select("vec_id", VX.laplace_noise(F.col("embedding"), F.col("vec_id"), 1.0).alias("embedding"))


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_TOP = f"SELECT a.vec_id AS query_id, b.vec_id AS match_id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) <= 5"


def _vectors(t):
    return VI.build(t.embeddings, "vec_id", "embedding")


def _candidates(t, k):
    """Queries are each fiftieth vector; candidates share their namespace."""
    return VI.top_matches(_vectors(t), t.embeddings.filter("vec_id % 50 = 0"), "vec_id", k, ["label"]).drop("rank")


def _topk(t):
    return _candidates(t, 5)


@query(_TOP)
def cosine_topk(t):
    return _topk(t)


@query("SELECT true AS enough")
def index_recall(t):
    """Whether the nearest cells alone hold nine tenths of the true matches among all vectors."""
    index, queries = _vectors(t), t.embeddings.filter("vec_id % 50 = 0")
    true = VI.top_matches(index, queries, "vec_id", 10)
    found = VI.top_matches(index, queries, "vec_id", 10, probes=VI.probes_for(index, "vec_id", 10), exact=False)
    return VI.recall(found, true).select((F.col("recall") >= 0.9).alias("enough"))


@query(f"SELECT avg(hit::INT) AS mean, avg(hit::INT) < 0.7 AS fails FROM (SELECT query_id, bool_or(match_id % 2 = 0) AS hit FROM ({_TOP}) GROUP BY 1)", ("mean",))
def retrieval_hit_rate(t):
    hit = _topk(t).groupBy("query_id").agg(F.bool_or(F.col("match_id") % 2 == 0).alias("hit"))
    m = F.avg(F.col("hit").cast("double"))
    return hit.agg(m.alias("mean"), (m < 0.7).alias("fails"))


@query("SELECT label, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY 1")
def index_statistics(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query()
def kmeans_select(t):
    """One vector for each of ten clusters, the one nearest its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=10, seed=42, maxIter=10).fit(v)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    s = model.transform(v).select("vec_id", F.col("prediction").alias("cluster"), VX.cosine(vector_to_array("features"), F.element_at(centres, F.col("prediction") + 1)).alias("score"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("vec_id", "cluster")


# access
_EDGES = "(VALUES ('admin', 'editor'), ('editor', 'viewer')) e(role, inherits)"
_CLOSE = f"WITH RECURSIVE c AS (SELECT role, role AS inherits, [role] AS path FROM (VALUES ('admin'), ('editor'), ('viewer')) r(role) UNION ALL SELECT c.role, e.inherits, list_append(c.path, e.inherits) FROM c JOIN {_EDGES} ON e.role = c.inherits WHERE NOT list_contains(c.path, e.inherits)) SELECT role, inherits, array_to_string(path, '>') AS path FROM c"
_POL = "(VALUES " + ", ".join(map(str, AC.POLICY)) + ") p(role, resource, action)"
PERMS = f"SELECT DISTINCT c.role, p.resource, p.action FROM ({_CLOSE}) c JOIN {_POL} ON p.role = c.inherits"


def _edges(t, rows=AC.HIERARCHY):
    return t.spark.createDataFrame(list(rows), "role string, inherits string")


def _closure(t):
    return AC.role_closure(t.spark, _edges(t), t.spark.createDataFrame([("admin",), ("editor",), ("viewer",)], "role string"))


def _permissions(t):
    return AC.effective_permissions(_closure(t), AC.policy(t.spark))


_ROLES = "SELECT n_name AS role, r_name AS inherits FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT n_name, 'TRADER' FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'TRADER', 'WORLD'"


def _nations(t):
    """Nations inherit their region, regions the world, some nations a role beside."""
    lands = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    one = t.nation.filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("role"), F.lit("TRADER").alias("inherits"))
    return lands.select(F.col("n_name").alias("role"), F.col("r_name").alias("inherits")).unionByName(t.region.select(F.col("r_name").alias("role"), F.lit("WORLD").alias("inherits"))).unionByName(one).unionByName(one.select("inherits").distinct().select(F.col("inherits").alias("role"), F.lit("WORLD").alias("inherits")))


@query(f"WITH RECURSIVE e AS ({_ROLES}), c AS (SELECT n_name AS role, n_name AS inherits, 0 AS steps FROM nation UNION SELECT c.role, e.inherits, c.steps + 1 FROM c JOIN e ON e.role = c.inherits) SELECT role, inherits, min(steps)::INT AS steps FROM c GROUP BY 1, 2")
def role_closure(t):
    """What each nation's role inherits, and how far."""
    return AC.role_closure(t.spark, _nations(t), t.nation.select(F.col("n_name").alias("role")))


_RING = "SELECT a.n_name AS role, b.n_name AS inherits FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 2 + 1) % (SELECT count(*) FROM nation)"


@query(f"WITH RECURSIVE e AS ({_RING}), c AS (SELECT role, inherits AS cur, [role, inherits] AS path FROM e UNION ALL SELECT c.role, e.inherits, list_append(path, e.inherits) FROM c JOIN e ON e.role = c.cur WHERE c.cur <> c.role AND len(path) < 99) SELECT role, array_to_string(path, '>') AS cycle FROM c WHERE cur = role")
def role_cycles(t):
    """Nations that inherit each other in rings, and some that only lead into one."""
    n = t.nation.count()
    b = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("inherits"))
    edges = t.nation.select(F.col("n_name").alias("role"), ((F.col("n_nationkey") * 2 + 1) % n).alias("k")).join(b, "k").select("role", "inherits")
    return AC.role_cycles(t.spark, edges)


@query(f"SELECT c_custkey, string_agg(resource, ',' ORDER BY resource) AS levels FROM customer JOIN ({PERMS}) p ON p.role = ['viewer', 'editor', 'admin'][(c_custkey % 3)::INT + 1] WHERE action = 'read' GROUP BY 1")
def accessible_levels(t):
    """The levels each customer may read by their role."""
    levels = _permissions(t).filter("action = 'read'").groupBy("role").agg(F.array_join(F.array_sort(F.collect_set("resource")), ",").alias("levels"))
    role = F.get(F.array(F.lit("viewer"), F.lit("editor"), F.lit("admin")), (F.col("c_custkey") % 3).cast("int"))
    return t.customer.select("c_custkey", role.alias("role")).join(levels, "role").select("c_custkey", "levels")


_LEVEL = "CASE WHEN contains(lower({p}), 'confidential') OR contains(lower({c}), 'confidential') THEN 'confidential' WHEN contains(lower({p}), 'internal') THEN 'internal' ELSE 'public' END"
_PATH = "concat(url, CASE page_id % 4 WHEN 0 THEN '/internal/x' WHEN 1 THEN '/Confidential/y' ELSE '/z' END)"


def _pages(t):
    p = F.col("page_id") % 4
    return t.pages.select("page_id", F.concat("url", F.when(p == 0, "/internal/x").when(p == 1, "/Confidential/y").otherwise("/z")).alias("path"), "html")


@query(f"SELECT page_id, {_LEVEL.format(p='path', c='html')} AS level FROM (SELECT page_id, {_PATH} AS path, html FROM pages)")
def access_level_classify(t):
    return _pages(t).select("page_id", T.access_level(F.col("path"), F.col("html")).alias("level"))


@query(f"WITH d AS (SELECT doc_id, length(text) AS n, ['public', 'internal', 'confidential'][1 + doc_id % 3] AS level FROM documents) SELECT doc_id, level FROM d WHERE level IN (SELECT resource FROM ({PERMS}) WHERE role = 'viewer' AND action = 'read') ORDER BY n DESC, doc_id LIMIT 10")
def rls_topk(t):
    level = F.get(F.array(F.lit("public"), F.lit("internal"), F.lit("confidential")), (F.col("doc_id") % 3).cast("int"))
    d = t.documents.select("doc_id", F.length("text").alias("n"), level.alias("level"))
    return AC.visible(d, "level", _permissions(t), F.lit("viewer")).orderBy(F.desc("n"), "doc_id").limit(10).select("doc_id", "level")


@query("SELECT p_partkey, p_brand, p_size, c.c_custkey, CASE WHEN p_brand = concat('Brand#', 1 + c.c_nationkey % 5, 1 + c.c_custkey % 5) AND c.c_custkey % 50 >= p_size - 1 THEN true ELSE false END AS allowed FROM orders JOIN customer c ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def abac_filter(t):
    """Each access (an order's line) is decided by attributes: the customer's department must be the part's brand, their clearance no less than its size."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    line = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")), "o_orderkey")
    j = line.join(c, "o_custkey").join(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    own = F.format_string("Brand#%d%d", 1 + F.col("c_nationkey") % 5, 1 + F.col("o_custkey") % 5)
    ok = AC.abac(own, F.col("p_brand"), F.col("o_custkey") % 50, F.col("p_size") - 1)
    return j.select("p_partkey", "p_brand", "p_size", F.col("o_custkey").alias("c_custkey"), ok.alias("allowed"))


# audit
AUDIT = """SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'document.access' WHEN 'click' THEN 'document.query' WHEN 'purchase' THEN 'data.export' WHEN 'error' THEN 'permission.denied' ELSE 'document.upload' END AS kind,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, ['public', 'internal', 'confidential', NULL][1 + event_id % 4] AS classification, json_extract_string(props, '$.k') AS resource_id, event_id % 4 = 2 AS pii FROM events"""
_JSON = """concat('{"action": "', kind, '", "event_id": "', event_id, '", "event_type": "', kind, '", "outcome": "', outcome, '", "resource_id": "', coalesce(resource_id, ''), '", "resource_type": "document", "timestamp": "', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '", "user_id": "', {u}, '"}')"""
_HASH = f"SELECT *, sha256({_JSON.replace('{u}', 'user_id')}) AS content_hash FROM ({AUDIT})"


def _audit(t):
    e = F.col("event_type")
    kind = F.when(e == "view", "document.access").when(e == "click", "document.query").when(e == "purchase", "data.export").when(e == "error", "permission.denied").otherwise("document.upload")
    cls = F.get(F.array(F.lit("public"), F.lit("internal"), F.lit("confidential"), F.lit(None).cast("string")), (F.col("event_id") % 4).cast("int"))
    return t.events.select("event_id", "ts", "user_id", kind.alias("kind"), F.when(e == "error", "failure").otherwise("success").alias("outcome"), cls.alias("classification"), F.get_json_object("props", "$.k").alias("resource_id"), (F.col("event_id") % 4 == 2).alias("pii"))


def _fields(user=None):
    c = F.col
    return {"action": c("kind"), "event_id": c("event_id"), "event_type": c("kind"), "outcome": c("outcome"), "resource_id": c("resource_id"), "resource_type": F.lit("document"), "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "user_id": c("user_id") if user is None else user}


@query(f"SELECT event_id, content_hash, lag(content_hash) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS previous_hash FROM ({_HASH})")
def audit_hash_chain(t):
    a = _audit(t).withColumn("content_hash", AU.content_hash(_fields())).withColumn("day", F.to_date("ts"))
    return AU.chained(a, ["day"], ["ts", "event_id"]).select("event_id", "content_hash", "previous_hash")


_TAMPER = f"SELECT *, CASE WHEN event_id % 500 = 0 THEN 'x' ELSE content_hash END AS stored, lag(content_hash) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS previous_hash FROM ({_HASH})"


def _stored(t):
    a = _audit(t).withColumn("content_hash", AU.content_hash(_fields())).withColumn("day", F.to_date("ts"))
    return AU.chained(a, ["day"], ["ts", "event_id"])


@query(f"SELECT event_id, previous_hash IS NOT DISTINCT FROM lag(stored) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS link_ok FROM ({_TAMPER})")
def chain_verify(t):
    """Stored hashes only, as the log's owner compares them; one in five hundred was changed."""
    log = _stored(t).withColumn("content_hash", F.when(F.col("event_id") % 500 == 0, "x").otherwise(F.col("content_hash")))
    return AU.verified(log, ["day"], ["ts", "event_id"]).select("event_id", "link_ok")


@query(f"SELECT event_id, CASE WHEN event_id % 700 = 0 THEN false ELSE true END AS content_ok FROM ({_HASH})")
def tamper_detect(t):
    """Users were changed in one of seven hundred rows: links hold, contents don't."""
    log = _stored(t).withColumn("user_id", F.when(F.col("event_id") % 700 == 0, -1).otherwise(F.col("user_id")))
    return AU.verified(log, ["day"], ["ts", "event_id"], AU.content_hash(_fields())).select("event_id", "content_ok")


@query(f"SELECT user_id, count(*) AS n, count(DISTINCT resource_id) AS resources, max(ts) AS last_access FROM ({AUDIT}) WHERE pii AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def pii_access_report(t):
    a = _audit(t).filter("pii and ts >= TIMESTAMP_NTZ '2024-01-10' and ts < TIMESTAMP_NTZ '2024-01-20'")
    return a.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("resource_id").alias("resources"), F.max("ts").alias("last_access"))


@query(f"SELECT count(*) AS reported, count(*) AS logged, true AS agrees FROM ({AUDIT}) WHERE pii")
def report_reconcile(t):
    a = _audit(t).filter("pii")
    return AU.reconciled(a.groupBy("user_id").agg(F.count("*").alias("n")), a)


@query(f"SELECT event_id, date_diff('day', ts::DATE, DATE '2024-06-30') > CASE classification WHEN 'public' THEN 90 WHEN 'confidential' THEN 2555 WHEN 'restricted' THEN 2555 ELSE 365 END AS expired FROM ({AUDIT})")
def retention_by_class(t):
    return _audit(t).select("event_id", AU.expiry(F.col("classification"), F.col("ts"), F.lit("2024-06-30")).alias("expired"))


@query("SELECT event_id, CASE WHEN d >= 365 THEN 'delete' WHEN d >= 90 THEN 'cold' WHEN d >= 30 THEN 'warm' ELSE 'hot' END AS phase FROM (SELECT event_id, date_diff('day', ts::DATE, DATE '2024-04-10') AS d FROM events)")
def ilm_phase(t):
    return t.events.select("event_id", AU.lifecycle_phase(F.col("ts"), F.lit("2024-04-10")).alias("phase"))


@query("SELECT event_id, CASE WHEN user_id % 9 = 0 THEN concat('anon_', substr(sha256(user_id::VARCHAR), 1, 12)) ELSE user_id::VARCHAR END AS user_id FROM events")
def anonymize_user(t):
    e = t.events.select("event_id", "user_id")
    return AU.anonymised(e, e.filter("user_id % 9 = 0").select("user_id"))


@query(f"SELECT user_id, count(*) AS events, count(*) FILTER (kind = 'document.query') AS queries, count(DISTINCT resource_id) AS documents, min(ts) AS first_seen FROM ({AUDIT}) WHERE user_id % 9 = 0 GROUP BY 1")
def access_export(t):
    return _audit(t).filter("user_id % 9 = 0").groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "document.query").alias("queries"), F.count_distinct("resource_id").alias("documents"), F.min("ts").alias("first_seen"))


@query(
    f"""WITH a AS (SELECT * FROM ({AUDIT}) WHERE user_id % 9 = 0)
    SELECT user_id, 'audit' AS section, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS since FROM a GROUP BY 1
    UNION ALL SELECT c_custkey, 'profile', 1, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM a)
    UNION ALL SELECT user_id, 'documents', count(DISTINCT resource_id), strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') FROM a WHERE kind = 'document.access' GROUP BY 1
    UNION ALL SELECT user_id, 'queries', count(*), strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') FROM a WHERE kind = 'document.query' GROUP BY 1"""
)
def access_report(t):
    """What is held of each person who asked, by section: audit trail, profile, documents, queries."""
    a = _audit(t).filter("user_id % 9 = 0")
    first = F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    section = lambda rows, name, n: rows.groupBy("user_id").agg(n.alias("n"), first.alias("since")).select("user_id", F.lit(name).alias("section"), "n", "since")
    profile = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("profile").alias("section"), F.lit(1).cast("long").alias("n"), F.col("c_mktsegment").alias("since")).join(a.select("user_id").distinct(), "user_id", "left_semi")
    return section(a, "audit", F.count("*")).unionByName(profile).unionByName(section(a.filter("kind = 'document.access'"), "documents", F.count_distinct("resource_id"))).unionByName(section(a.filter("kind = 'document.query'"), "queries", F.count("*")))


@query(f"SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n FROM ({AUDIT}) WHERE kind = 'document.access' GROUP BY 1, 2")
def audit_heatmap(t):
    return _audit(t).filter("kind = 'document.access'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "user_id").agg(F.count("*").alias("n"))


@query(f"SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (pii) AS pii, count(*) FILTER (kind = 'permission.denied' AND outcome = 'failure') AS denied, count(*) FILTER (kind IN ('data.export', 'data.deletion')) AS gdpr FROM ({AUDIT}) GROUP BY 1")
def compliance_dashboard(t):
    return _audit(t).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if("pii").alias("pii"), F.count_if((F.col("kind") == "permission.denied") & (F.col("outcome") == "failure")).alias("denied"), F.count_if(F.col("kind").isin("data.export", "data.deletion")).alias("gdpr"))


@query("SELECT 'events' AS table_name, count(*) AS n_deleted, CASE WHEN count(*) > 0 THEN 'COMPLETED' ELSE 'NO_DATA_FOUND' END AS status FROM events WHERE user_id % 9 = 0 UNION ALL SELECT 'orders', count(*), CASE WHEN count(*) > 0 THEN 'COMPLETED' ELSE 'NO_DATA_FOUND' END FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE user_id % 9 = 0)")
def gdpr_erasure(t):
    users = t.events.filter("user_id % 9 = 0").select("user_id").distinct()
    return AU.erased({"events": (t.events, "user_id"), "orders": (t.orders, "o_custkey")}, users, "user_id")[1]


_M = "CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END"
_AP = "CASE page_id % 5 WHEN 0 THEN '/api/query' WHEN 1 THEN concat('/api/data-export/', page_id) ELSE concat('/api/documents/', page_id) END"


@query(f"SELECT page_id, CASE WHEN contains(p, '/query') THEN 'document.query' WHEN contains(p, '/documents') THEN CASE m WHEN 'GET' THEN 'document.access' WHEN 'POST' THEN 'document.upload' ELSE 'document.delete' END WHEN contains(p, '/data-export') THEN 'data.export' ELSE 'document.access' END AS kind, regexp_extract(p, '/documents/([^/]+)', 1) AS resource_id FROM (SELECT page_id, {_M} AS m, {_AP} AS p FROM pages)")
def event_type_rules(t):
    i = F.col("page_id")
    p = F.when(i % 5 == 0, "/api/query").when(i % 5 == 1, F.concat(F.lit("/api/data-export/"), i.cast("string"))).otherwise(F.concat(F.lit("/api/documents/"), i.cast("string")))
    m = F.when(i % 3 == 0, "GET").when(i % 3 == 1, "POST").otherwise("DELETE")
    return t.pages.select("page_id", AU.event_type(p, m).alias("kind"), F.regexp_extract(p, "/documents/([^/]+)", 1).alias("resource_id"))


@query("SELECT user_id, concat('anon_', substr(sha256(user_id::VARCHAR), 1, 12)) AS anon, substr(md5(user_id::VARCHAR), 1, 6) AS short_id FROM (SELECT DISTINCT user_id FROM events)")
def hashed_ids(t):
    u = t.events.select("user_id").distinct()
    return u.select("user_id", anonymous_id(F.col("user_id")).alias("anon"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 6).alias("short_id"))
