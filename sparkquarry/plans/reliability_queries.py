"""Commits, buffers, expiring state, file changes, work that resumes, backups in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import backups as BK
from ..sources import ledger as LG
from ..sources.commits import CommitLog, Conflict
from ..sources.ledger import Ledger
from ..sources.shared import shared_path
from ..sources.storage import Storage
from ..streaming import timers as TM
from ..streaming import watch as WA
from ..streaming import windows as ST
from .registry import query

_COMMITTED = """SELECT doc_id, source, concat(CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'b' ELSE '' END, CASE WHEN doc_id % 15 = 7 THEN 'c' ELSE '' END) AS marks,
CASE WHEN doc_id % 5 = 0 THEN 4 WHEN doc_id % 15 = 7 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 15 <> 13"""


@query(_COMMITTED)
def concurrent_commits(t):
    """Three writers change documents from the same state: two don't meet, the third does and begins again."""
    log = CommitLog(t.spark, shared_path(t.spark, "commits"), "doc_id bigint, source string, marks string, version int", "doc_id")
    log.commit(log.write(t.documents.select("doc_id", "source", F.lit("").alias("marks"), F.lit(1).alias("version"))))
    state = log.snapshot()

    def marked(rows, letter, version):
        return rows.withColumn("marks", F.concat("marks", F.lit(letter))).withColumn("version", F.lit(version))

    a = log.write(marked(state.filter("doc_id % 3 = 0"), "a", 2))
    b = log.write(marked(state.filter("doc_id % 5 = 0"), "b", 4))
    c = log.write(marked(state.filter("doc_id % 15 = 7"), "c", 3), state.filter("doc_id % 15 = 13"))
    log.commit(a)
    log.commit(c)
    try:
        log.commit(b)
    except Conflict:
        log.abort(b)
        log.apply(lambda now: (marked(now.filter("doc_id % 5 = 0"), "b", 4), None))
    return log.snapshot()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def reverted_version(t):
    """A version that turned out bad is passed over by readers, later ones stay; the state moves to a base."""
    log = CommitLog(t.spark, shared_path(t.spark, "commits"), "doc_id bigint, state string", "doc_id")
    docs = t.documents.select("doc_id")
    log.commit(log.write(docs.withColumn("state", F.lit("old"))))
    bad = log.commit(log.write(docs.filter("doc_id % 2 = 0").withColumn("state", F.lit("bad")), docs.filter("doc_id % 7 = 0")))
    log.commit(log.write(docs.filter("doc_id % 3 = 0").withColumn("state", F.lit("new"))))
    log.revert(bad)
    log.compact()
    return log.snapshot()


# streams over the events in three slices of time, each run to its end and started again from its checkpoint
_DAYS5 = 5 * 86400


@query(
    f"""WITH e AS (SELECT user_id, event_id, floor(epoch(ts) / {_DAYS5})::BIGINT AS tick, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / {_DAYS5}) ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id, make_timestamp(tick * {_DAYS5} * 1000000) AS tick, (i // 4)::INT AS block, count(*)::INT AS n, CASE WHEN count(*) = 4 THEN 'count' ELSE 'time' END AS why, string_agg(event_id, ',' ORDER BY i) AS event_ids
    FROM e GROUP BY user_id, e.tick, i // 4 HAVING count(*) = 4 OR (e.tick + 1) * {_DAYS5} * 1000 < (SELECT epoch_ms(max(ts)) FROM events)"""
)
def stream_buffered(t):
    """Each user's events in buffers that are flushed at four events or every five days; what is still buffered at the end isn't there."""
    e = t.events.select("event_id", "user_id", "ts")
    out = ST.drain_in_slices(e, shared_path(t.spark, "stream_buffered"), lambda s: TM.buffered(s, "user_id", "event_id", most=4, seconds=_DAYS5))
    return out.select("user_id", F.col("tick").cast("timestamp_ntz").alias("tick"), "block", "n", "why", F.array_join("events", ",").alias("event_ids"))


@query(
    """WITH RECURSIVE r AS (
    SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
    UNION ALL SELECT r.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR) FROM r WHERE r.ts IS NOT NULL)
    SELECT min(e.event_id) AS event_id, r.user_id, r.ts FROM r JOIN events e ON e.user_id = r.user_id AND e.ts = r.ts GROUP BY 2, 3"""
)
def stream_cooldown(t):
    """Six hours of silence after each alert of a user."""
    e = t.events.select("event_id", "user_id", "ts")
    out = ST.drain_in_slices(e, shared_path(t.spark, "stream_cooldown"), lambda s: TM.cooldown(s, "user_id", 6 * 3600, "0 seconds"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_GAP, _KEEP = 6 * 3600, 12 * 3600


@query(
    f"""WITH RECURSIVE a AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= to_seconds({_GAP}) THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a),
    i AS (SELECT user_id, s, min(ts) AS start_at, max(ts) AS end_at, count(*)::INT AS n, max(value) AS worst FROM b GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN lag(end_at) OVER w IS NULL OR start_at - lag(end_at) OVER w >= to_seconds({_GAP + _KEEP}) THEN 1 ELSE 0 END AS anew FROM i WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    g AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY s) AS c FROM f)
    SELECT user_id, start_at, end_at, n, worst, (row_number() OVER (PARTITION BY user_id, c ORDER BY s))::INT AS recurrence FROM g QUALIFY end_at + to_seconds({_GAP}) < (SELECT max(ts) FROM events)"""
)
def stream_incidents(t):
    """Incidents of a user end after six hours without an event and are remembered for twelve more."""
    e = t.events.select("event_id", "user_id", "ts", "value")
    out = ST.drain_in_slices(e, shared_path(t.spark, "stream_incidents"), lambda s: TM.incidents(s, "user_id", "value", _GAP, _KEEP))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})


@query("SELECT vec_id, CASE WHEN vec_id % 35 = 0 THEN NULL ELSE label * 2 END AS doubled, CASE WHEN vec_id % 35 = 0 THEN 'fallback' ELSE 'transformed' END AS how, CASE WHEN vec_id % 35 = 0 THEN 3 WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS attempts, vec_id % 35 = 0 AS failed FROM embeddings")
def resumed_migration(t):
    """Vectors moved with a transform that fails for some rows once and for some always; stopped half-way and taken up again."""
    ledger = Ledger(t.spark, shared_path(t.spark, "migration"))
    rows = t.embeddings

    def transform(attempt):
        fails = (F.col("vec_id") % 35 == 0) | ((F.col("vec_id") % 5 == 0) & F.lit(attempt == 0))
        return F.when(~fails, F.col("label") * 2), F.when(fails, F.lit("refused"))

    first = LG.copy_in_ranges(rows, "vec_id", ledger, transform, F.lit(None).cast("int"), n=8, wave=3, most=4)
    rest = LG.copy_in_ranges(rows, "vec_id", ledger, transform, F.lit(None).cast("int"), n=8, wave=3)
    again = LG.copy_in_ranges(rows, "vec_id", ledger, transform, F.lit(None).cast("int"), n=8, wave=3)
    if first + rest != len(ledger.finished()) or again:
        raise RuntimeError("a range was worked on twice")
    bad = LG.failures(ledger, rows).select("vec_id", F.lit(True).alias("bad"))
    out = LG.copied(ledger, rows, "int").join(bad, "vec_id", "left")
    return out.select("vec_id", F.col("_value").alias("doubled"), F.col("_how").alias("how"), F.col("_attempts").alias("attempts"), F.coalesce("bad", F.lit(False)).alias("failed"))


@query("SELECT count(*) AS n, avg(value) AS mean, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS error_share FROM events", ("mean", "error_share"))
def resumed_evaluation(t):
    """Means over all events from the sums of ranges, of which some were worked on before a stop and some after it."""
    ledger = Ledger(t.spark, shared_path(t.spark, "evaluation"))
    partial = {"n": F.count("*"), "total": F.sum("value"), "errors": F.count_if(F.col("event_type") == "error")}
    LG.sums_in_ranges(t.events, "event_id", ledger, partial, n=8, wave=3, most=3)
    LG.sums_in_ranges(t.events, "event_id", ledger, partial, n=8, wave=3)
    s = LG.sums(ledger, "n long, total double, errors long")
    return s.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("errors").cast("double") / F.sum("n")).alias("error_share"))


_PART = 100_000
_VECTOR = "(16 + 4 * len(embedding) + strlen(vec_id::VARCHAR))::BIGINT"


@query(f"SELECT part, count(*) AS n, sum(size)::BIGINT AS bytes, min(vec_id) AS first, max(vec_id) AS last, count(*) AS restored FROM (SELECT *, (coalesce(sum(size) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_PART})::BIGINT AS part FROM (SELECT vec_id, {_VECTOR} AS size FROM embeddings)) GROUP BY part")
def backup_in_parts(t):
    """Embeddings written in parts of a bounded number of bytes, verified and restored."""
    path = shared_path(t.spark, "backup")
    size = 16 + 4 * F.size("embedding") + F.octet_length(F.col("vec_id").cast("string"))
    manifest = BK.backup_parts(t.embeddings, path, "vec_id", size, _PART)
    back = BK.restore_parts(t.spark, path, "vec_id long, embedding array<float>, label int")
    same = back.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("was")), F.col("vec_id") == F.col("id")).filter(F.col("embedding") == F.col("was"))
    return manifest.join(same.groupBy("part").agg(F.count("*").alias("restored")), "part")


_FILES = """f AS (SELECT source || '.txt' AS path, substr(source, 4)::INT AS k, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)"""


@query(
    f"""WITH {_FILES} SELECT 1 AS listing, path, 'created' AS kind, length FROM f WHERE k % 3 <> 0
    UNION ALL SELECT 2, path, 'created', length FROM f WHERE k % 3 = 0 UNION ALL SELECT 2, path, 'modified', length + n FROM f WHERE k % 3 <> 0 AND k % 4 = 1
    UNION ALL SELECT 3, path, 'deleted', CASE WHEN k % 3 <> 0 AND k % 4 = 1 THEN length + n ELSE length END FROM f WHERE k % 5 = 0"""
)
def stream_file_changes(t):
    """Each source's documents as a file; files come, change and go between three runs of the stream."""
    path = shared_path(t.spark, "watched")
    store = Storage(t.spark, path)
    store.fs.mkdirs(store.path("files"))
    docs = t.documents.filter("source is not null").select("source", F.coalesce("text", F.lit("")).alias("text"), F.substring("source", 4, 9).cast("int").alias("k"))

    def put(rows, name):
        rows.select("source", "text").repartition("source").write.partitionBy("source").text(f"{path}/{name}")
        for folder in store.names(name):
            if folder.startswith("source="):
                to = f"files/{folder.removeprefix('source=')}.txt"
                store.delete(to)
                store.move(f"{name}/{folder}/{next(n for n in store.names(f'{name}/{folder}') if n.startswith('part-'))}", to)

    def drained():
        return ST.drain(WA.folder_changes(t.spark, f"{path}/files", f"{path}/listings", (".txt",)), f"{path}/stream", "append")

    put(docs.filter("k % 3 <> 0"), "one")
    drained()
    put(docs.filter("k % 3 = 0"), "two")
    put(docs.filter("k % 3 <> 0 and k % 4 = 1").withColumn("text", F.concat("text", F.lit("x"))), "three")
    drained()
    for name in store.names("files"):
        if int(name.removeprefix("src").removesuffix(".txt")) % 5 == 0:
            store.delete(f"files/{name}")
    return drained().select("listing", "path", "kind", "length")
