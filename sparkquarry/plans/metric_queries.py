"""Metrics, anomalies, alerts: events stand for samples, a user's events of a type are a series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import forecast as FC
from ..operators import series as S
from .registry import query

BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)
_E = "epoch(date_trunc('second', ts))::BIGINT"
DELTA = """
SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta
FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS prev FROM events)"""
BUCKETS = f"""
SELECT e.event_type, b.le, count(*) FILTER (e.value <= b.le) AS n
FROM events e, (SELECT unnest([{', '.join(map(str, BOUNDS))}, 'inf'::DOUBLE]::DOUBLE[]) AS le) b WHERE e.value IS NOT NULL GROUP BY 1, 2"""


@query(f"SELECT event_type, user_id, sum(delta) AS increase FROM ({DELTA}) GROUP BY 1, 2", ("increase",))
def counter_increase(t):
    return S.increases(t.events, ["event_type", "user_id"]).groupBy("event_type", "user_id").agg(F.sum("delta").alias("increase"))


@query(f"SELECT event_id, sum(delta) OVER (PARTITION BY event_type, user_id ORDER BY {_E} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 86400 AS rate FROM ({DELTA})", ("rate",))
def counter_rate(t):
    w = S.trailing(["event_type", "user_id"], 86400)
    return S.increases(t.events, ["event_type", "user_id"]).select("event_id", (F.sum("delta").over(w) / 86400).alias("rate"))


@query(f"SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY {_E} RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS mean FROM events", ("mean",))
def avg_over_time(t):
    return t.events.select("event_id", F.avg("value").over(S.trailing(["user_id"], 3600)).alias("mean"))


@query(BUCKETS)
def histogram_buckets(t):
    return S.bucket_counts(t.events, ["event_type"], BOUNDS)


@query(
    f"""WITH b AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, 0.95 * max(n) OVER (PARTITION BY event_type) AS rank FROM ({BUCKETS}) WINDOW w AS (PARTITION BY event_type ORDER BY le)),
    h AS (SELECT * FROM b WHERE n >= rank AND n > 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1)
    SELECT event_type, CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (rank - below)::DOUBLE / (n - below) END AS quantile FROM h""",
    ("quantile",),
)
def histogram_quantile(t):
    return S.bucket_quantile(S.bucket_counts(t.events, ["event_type"], BOUNDS), ["event_type"], 0.95)


@query(
    f"""WITH a AS (SELECT *, value > 20 AS o FROM events),
    b AS (SELECT *, CASE WHEN lag(o) OVER w IS DISTINCT FROM o THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM b)
    SELECT event_id, o AND {_E} - min({_E}) OVER (PARTITION BY user_id, isl) >= 3600 AS firing FROM c"""
)
def alert_for_duration(t):
    return S.sustained(t.events, ["user_id"], F.col("value") > 20, 3600).select("event_id", "firing")


_DAILY = "SELECT event_type, date_trunc('day', ts)::DATE AS day, sum(value) AS total FROM events GROUP BY 1, 2"


def _daily(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))


@query(f"WITH d AS ({_DAILY}) SELECT a.event_type, a.day, a.total, b.total AS week_before, a.total > b.total * 1.5 AS alarming FROM d a JOIN d b ON a.event_type = b.event_type AND a.day = b.day + 7", ("total", "week_before"))
def offset_compare(t):
    d = _daily(t)
    before = d.select("event_type", F.date_add("day", 7).alias("day"), F.col("total").alias("week_before"))
    return d.join(before, ["event_type", "day"]).withColumn("alarming", F.col("total") > F.col("week_before") * 1.5)


@query("SELECT event_type, to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS bucket, count(*)::DOUBLE / 300 AS rate FROM events GROUP BY 1, 2", ("rate",))
def recording_rule(t):
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"].cast("timestamp_ntz")
    return t.events.groupBy("event_type", w.alias("bucket")).agg((F.count("*") / F.lit(300.0)).alias("rate"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def hourly_counts(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("hour")).limit(24)


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.95)::BIGINT + 1] AS nearest_rank FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_p95_nearest_rank(t):
    return S.nearest_rank(t.events, ["event_type"], 0.95)


@query("SELECT event_type, max_by(value, ts) AS latest, max(ts) AS at FROM events GROUP BY 1")
def instant_value(t):
    return t.events.groupBy("event_type").agg(F.max_by("value", "ts").alias("latest"), F.max("ts").alias("at"))


@query("SELECT user_id, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, stddev_pop(value) AS sd, avg(value) AS mean FROM events GROUP BY 1", ("p50", "p90", "sd", "mean"))
def value_statistics(t):
    return t.events.groupBy("user_id").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"), F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"))


@query(
    "WITH g AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS hour), c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) SELECT g.hour, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (hour)"
)
def metric_history(t):
    """Hourly grid over the whole range, empty hours included."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    counts = t.events.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    grid = counts.agg(F.explode(F.sequence(F.min("hour"), F.max("hour"), F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(counts, "hour", "left").select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


_HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour, sum(value) AS v FROM events GROUP BY 1, 2"
ANOMALY = f"""
WITH h AS ({_HOURLY}),
b AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM h
  WINDOW w AS (PARTITION BY event_type, hour(hour) ORDER BY epoch(hour)::BIGINT RANGE BETWEEN 604800 PRECEDING AND 3600 PRECEDING))
SELECT event_type, hour, v, n, CASE WHEN n >= 3 THEN m END AS expected, CASE WHEN n < 3 OR s < 1e-9 THEN 0 ELSE abs(v - m) / s END AS severity FROM b"""


def _hourly(t):
    return t.events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.sum("value").alias("v"))


def _scored(t):
    return A.seasonal_scores(_hourly(t), ["event_type"], "hour", "v")


@query(f"SELECT event_type, hour, expected, severity, round(severity, 6) >= 3 AS is_anomaly FROM ({ANOMALY})", ("expected", "severity"))
def seasonal_anomaly(t):
    s = _scored(t)
    return s.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "expected", "severity", (F.round("severity", 6) >= 3).alias("is_anomaly"))

# the same normal equations, solved by elimination; the matrix of a series is positive definite, so no rows change places
_WAVES = ", ".join(f"{f}(2 * pi() * {k} * ((e % {period}) / {period}::DOUBLE))" for period, order in ((FC.DAY, FC.DAILY), (FC.WEEK, FC.WEEKLY)) for k in range(1, order + 1) for f in ("sin", "cos"))
_CHANGES = ", ".join(f"greatest(tau - {FC.HISTORY} * {j} / {FC.CHANGE_POINTS + 1}, 0)" for j in range(1, FC.CHANGE_POINTS + 1))
_P = FC.SIZE
FORECAST = f"""
WITH RECURSIVE h AS (SELECT event_type, hour, v, epoch(hour)::BIGINT AS e FROM ({_HOURLY})),
t AS (SELECT *, (e - min(e) OVER w)::DOUBLE / nullif(max(e) OVER w - min(e) OVER w, 0) AS t0 FROM h WINDOW w AS (PARTITION BY event_type)),
x AS (SELECT event_type, hour, v, [1.0::DOUBLE, tau, {_CHANGES}, {_WAVES}] AS x FROM (SELECT *, coalesce(t0, 0) AS tau FROM t)),
cell AS (SELECT event_type, i, j, sum(x[i] * CASE WHEN j <= {_P} THEN x[j] ELSE v END) AS a FROM x, (SELECT unnest(range(1, {_P + 1})) AS i) ii, (SELECT unnest(range(1, {_P + 2})) AS j) jj GROUP BY ALL),
pen AS (SELECT event_type, i, list(a + CASE WHEN i = j THEN ({FC.PENALTIES})[i] ELSE 0 END ORDER BY j) AS r FROM cell GROUP BY event_type, i),
m AS (SELECT event_type, list(r ORDER BY i) AS m FROM pen GROUP BY event_type),
g AS (SELECT event_type, 1 AS k, m FROM m UNION ALL
  SELECT event_type, k + 1, list_transform(range(1, {_P + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda a: a / m[k][k])
    ELSE list_transform(range(1, {_P + 2}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= {_P}),
c AS (SELECT event_type, list_transform(m, lambda r: r[{_P + 1}]) AS c FROM g WHERE k = {_P + 1}),
f AS (SELECT x.event_type, hour, v, list_sum(list_transform(list_zip(x, c), lambda z: z[1] * z[2])) AS expected FROM x JOIN c USING (event_type)),
s AS (SELECT event_type, CASE WHEN count(*) > {_P} THEN sqrt(sum((v - expected) * (v - expected)) / (count(*) - {_P})) END AS sigma FROM f GROUP BY 1)
SELECT event_type, hour, expected, expected - {FC.WIDTH} * sigma AS lower, expected + {FC.WIDTH} * sigma AS upper,
  CASE WHEN {FC.WIDTH} * sigma / 3 > 1e-9 THEN abs(v - expected) / ({FC.WIDTH} * sigma / 3) ELSE 0 END AS severity FROM f JOIN s USING (event_type)"""


def _forecast(t):
    h = _hourly(t).withColumn("e", F.unix_timestamp("hour"))
    model = FC.fit(h, ["event_type"], "e", "v")
    return FC.forecast(h, model, ["event_type"], "e").withColumn("severity", FC.severity(F.col("v")))


@query(FORECAST, ("expected", "lower", "upper", "severity"))
def seasonal_forecast(t):
    """Each hour's value beside its forecast interval of 0.997, and by how many thirds of the half it is off."""
    return _forecast(t).select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "expected", "lower", "upper", "severity")


@query(f"SELECT event_type, hour, CASE WHEN round(severity, 6) > 4 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN round(severity, 6) > 4 THEN 'high' ELSE 'low' END AS urgency FROM ({FORECAST}) WHERE round(severity, 6) >= 2")
def forecast_alerts(t):
    """Hours that are off by two or more, with severity and urgency."""
    off = F.round("severity", 6)
    name, how = FC.alert_level(off)
    return _forecast(t).filter(off >= 2).select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), name.alias("severity"), how.alias("urgency"))


_MULTI = f"""WITH s AS (SELECT *, round(severity, 6) AS sev FROM ({ANOMALY}))
SELECT event_type, hour, sev, avg((sev >= 1)::INT) OVER (PARTITION BY event_type ORDER BY epoch(hour)::BIGINT RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS share FROM s"""


@query(f"SELECT event_type, hour, CASE WHEN sev >= 3 THEN 'page' WHEN sev >= 2 AND share > 0.3 THEN 'page_sustained' WHEN sev >= 1 THEN 'log' ELSE 'none' END AS action FROM ({_MULTI})")
def multi_threshold(t):
    s = _scored(t).withColumn("severity", F.round("severity", 6))
    return A.threshold_actions(s, ["event_type"], "hour", page=3.0, watch=2.0, log=1.0, seconds=21600, share=0.3).select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "action")


@query(
    f"""WITH s AS (SELECT hour, event_type, round(severity, 6) >= 2 AS a FROM ({ANOMALY}))
    SELECT hour, CASE WHEN bool_or(a AND event_type = 'view') AND bool_or(a AND event_type <> 'view') THEN 'critical' WHEN bool_or(a) THEN 'info' ELSE 'none' END AS severity FROM s GROUP BY hour"""
)
def context_aware(t):
    s = _scored(t).withColumn("a", F.round("severity", 6) >= 2)
    return A.in_context(s, "hour", F.col("event_type") == "view").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "severity")


_EXCL = "SELECT * FROM (VALUES (TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-07 00:00:00'), (TIMESTAMP '2024-01-20 12:00:00', TIMESTAMP '2024-01-21 12:00:00')) v(start_at, end_at)"


@query(f"WITH x AS ({_EXCL}) SELECT event_type, hour, round(severity, 6) >= CASE WHEN EXISTS (SELECT 1 FROM x WHERE hour >= start_at AND hour < end_at) THEN 5 ELSE 3 END AS is_anomaly FROM ({ANOMALY}) a")
def exclusion_windows(t):
    windows = t.spark.sql(_EXCL)
    s = _scored(t).withColumn("severity", F.round("severity", 6)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    return A.with_exclusions(s, windows, "hour", usual=3.0, inside=5.0).select("event_type", "hour", "is_anomaly")


ALERTS = """
SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN 'QueryTimeout' WHEN 1 THEN 'CacheMissRate' WHEN 2 THEN 'OpenAIRateLimit' WHEN 3 THEN 'HighMemoryUsage' WHEN 4 THEN 'DiskSpaceLow' ELSE 'UnknownThing' END AS name,
  CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity FROM events WHERE value > 10"""
_GROUP = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(n) for n in names)}) THEN '{g}'" for g, names in A.CORRELATION.items()) + " ELSE concat('uncorrelated_', name) END"


def _alerts(t):
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(ALERTS)


@query(
    f"""WITH a AS (SELECT *, {_GROUP} AS grp, CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS lvl FROM ({ALERTS})),
    b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY grp ORDER BY ts, event_id)),
    c AS (SELECT *, sum(nw) OVER (PARTITION BY grp ORDER BY ts, event_id) AS session FROM b)
    SELECT concat(grp, '_', strftime(min(ts), '%Y%m%d_%H%M%S')) AS incident_id, grp AS correlation_group, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_alerts,
      CASE max(lvl) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity FROM c GROUP BY grp, session"""
)
def alert_incidents(t):
    return A.incidents(_alerts(t), 300)


@query(
    f"""WITH RECURSIVE a AS MATERIALIZED (SELECT event_id, concat(name, ':', severity) AS fp, epoch_us(ts) AS us FROM ({ALERTS})),
    r AS (SELECT fp, min(us) AS us FROM a GROUP BY 1 UNION ALL SELECT r.fp, min(a.us) FROM r JOIN a ON a.fp = r.fp AND a.us >= r.us + 300000000 GROUP BY r.fp),
    f AS (SELECT a.fp, a.us, min(event_id) AS event_id FROM a JOIN r ON a.fp = r.fp AND a.us = r.us GROUP BY 1, 2)
    SELECT event_id, event_id NOT IN (SELECT event_id FROM f) AS is_duplicate FROM a"""
)
def alert_dedup(t):
    """First-recorded rule: a fold over each fingerprint's alerts, five minutes from the alert that was let through."""
    return A.deduplicated(_alerts(t), ["name", "severity"], 300).select("event_id", "is_duplicate")


_SHIFTS = "SELECT user_id % 10 AS policy, ts AS start_at, ts + INTERVAL 5 MINUTE AS end_at FROM events"


@query(f"WITH s AS ({_SHIFTS}), r AS (SELECT *, max(end_at) OVER (PARTITION BY policy ORDER BY start_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT policy, reach AS gap_start, start_at AS gap_end FROM r WHERE start_at > reach")
def oncall_gaps(t):
    shifts = t.events.select((F.col("user_id") % 10).alias("policy"), F.col("ts").alias("start_at"), (F.col("ts") + F.expr("interval 5 minutes")).alias("end_at"))
    return S.coverage_gaps(shifts, ["policy"], "start_at", "end_at")


_BOOKS = " UNION ALL ".join(f"SELECT {i} AS priority, '{n}' AS runbook, '{a}' AS name, {str(ap).upper()} AS needs_approval" for i, (n, names, ap) in enumerate(A.RUNBOOKS) for a in names)


@query(
    f"""WITH a AS ({ALERTS}), r AS ({_BOOKS}), m AS (SELECT a.event_id, a.name, r.runbook, r.needs_approval, row_number() OVER (PARTITION BY a.event_id ORDER BY r.priority NULLS LAST) AS k FROM a LEFT JOIN r USING (name))
    SELECT event_id, name, runbook, CASE WHEN runbook IS NULL THEN 'no_runbook' WHEN needs_approval THEN 'awaiting_approval' ELSE 'execute' END AS decision FROM m WHERE k = 1"""
)
def runbook_match(t):
    return A.match_runbooks(_alerts(t)).select("event_id", "name", "runbook", "decision")
