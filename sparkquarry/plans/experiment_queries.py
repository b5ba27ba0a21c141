"""Experiments and statistics over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import normal_sf
from ..operators import experiments as X
from .registry import query

VARIANT = "CASE WHEN concat('0x', substr(md5(concat({u}, ':{e}')), 1, 8))::UBIGINT::DOUBLE / 4294967296 < 0.5 THEN 'treatment' ELSE 'control' END"
_V = VARIANT.format(u="user_id::VARCHAR", e="exp_001")
WELCH = """
SELECT {g}, nc AS n_control, mc AS mean_control, nt AS n_treatment, mt AS mean_treatment, mt - mc AS difference,
  CASE WHEN nt > 1 AND nc > 1 THEN (mt - mc) / sqrt(vt / nt + vc / nc) END AS t,
  CASE WHEN nt > 1 AND nc > 1 THEN (vt / nt + vc / nc) ^ 2 / ((vt / nt) ^ 2 / (nt - 1) + (vc / nc) ^ 2 / (nc - 1)) END AS df
FROM (SELECT {g}, count(value) FILTER (v = 'control') AS nc, count(value) FILTER (v = 'treatment') AS nt, avg(value) FILTER (v = 'control') AS mc, avg(value) FILTER (v = 'treatment') AS mt,
  var_samp(value) FILTER (v = 'control') AS vc, var_samp(value) FILTER (v = 'treatment') AS vt FROM (SELECT *, {v} AS v FROM events) GROUP BY {g})"""
_BY_TYPE = WELCH.format(g="event_type", v=_V)


def _sampled(t, experiment="exp_001"):
    return t.events.withColumn("variant", X.variant(F.col("user_id"), experiment))


@query(f"SELECT DISTINCT user_id, {_V} AS variant FROM events")
def variant_assignment(t):
    return _sampled(t).select("user_id", "variant").distinct()


@query(f"WITH h AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0) SELECT u.user_id, CASE WHEN h.user_id IS NOT NULL THEN 'control' ELSE {VARIANT.format(u='u.user_id::VARCHAR', e='exp_001')} END AS variant, h.user_id IS NULL AS is_new FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN h USING (user_id)")
def idempotent_assignment(t):
    users = t.events.select("user_id").distinct()
    return X.assign(users, users.filter("user_id % 10 = 0").withColumn("variant", F.lit("control")), "user_id", "exp_001")


@query(f"WITH a AS (SELECT DISTINCT user_id, {_V} AS variant FROM events) SELECT variant, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM a GROUP BY 1", ("share",))
def variant_distribution(t):
    n = _sampled(t).select("user_id", "variant").distinct().groupBy("variant").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("_all"))).select("variant", "n", (F.col("n") * 100.0 / F.col("_all")).alias("share"))


@query(_BY_TYPE, ("mean_control", "mean_treatment", "difference", "t", "df"))
def welch_ttest(t):
    return X.welch(_sampled(t), ["event_type"]).drop("p")


@query()
def experiment_analysis(t):
    """Welch with p, winner and recommendation; p is beyond SQL, so rows only, with tabulated values in the tests."""
    w = X.welch(_sampled(t), ["event_type"])
    won = X.winner(F.col("p"), F.col("difference"))
    return w.withColumn("winner", won).withColumn("recommendation", X.recommendation(won, F.col("n_control"), F.col("n_treatment")))


@query(f"SELECT event_type, abs(t) > 1.96 AS is_significant, abs(t) > 1.96 AND n_treatment >= 1000 AS can_stop FROM ({_BY_TYPE})")
def early_stopping(t):
    """With the large-sample bound for t."""
    w = X.welch(_sampled(t), ["event_type"])
    return w.select("event_type", (F.abs("t") > 1.96).alias("is_significant"), ((F.abs("t") > 1.96) & (F.col("n_treatment") >= 1000)).alias("can_stop"))


_PAIR = "SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS before, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1"


@query(f"SELECT count(after - before) AS n, avg(after - before) AS mean_difference, avg(after - before) / (stddev_samp(after - before) / sqrt(count(after - before))) AS t FROM ({_PAIR})", ("mean_difference", "t"))
def paired_ttest(t):
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    pairs = t.events.groupBy("user_id").agg(F.avg(F.when(F.col("ts") < half, F.col("value"))).alias("before"), F.avg(F.when(F.col("ts") >= half, F.col("value"))).alias("after"))
    return X.paired(pairs, [], "before", "after").drop("p")


@query()
def bootstrap_ci(t):
    return X.bootstrap_interval(_sampled(t).filter("event_type = 'click'"))


_P = "SELECT concat('exp_', lpad(user_id::VARCHAR, 4, '0')) AS experiment_id, (count(*) % 97 + 1) / 1000.0::DOUBLE AS p FROM events GROUP BY user_id"


def _tests(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("exp_"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("experiment_id"), ((F.col("n") % 97 + 1) / 1000.0).alias("p"))


@query(f"SELECT *, 0.05 / count(p) OVER () AS corrected_alpha, p < 0.05 / count(p) OVER () AS significant FROM ({_P})", ("corrected_alpha",))
def bonferroni(t):
    return X.bonferroni(_tests(t))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY p, experiment_id) AS r, count(*) OVER () AS m FROM ({_P})) SELECT experiment_id, p, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM r", ("p", "p_adjusted"))
def bh_fdr(t):
    return X.benjamini_hochberg(_tests(t))


@query("SELECT event_type, share, ceil(2 * ((1.959963984540054 + 0.8416212335729143) * round(sd, 6) / (share * round(mean, 6))) ^ 2)::BIGINT AS n FROM (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd, count(DISTINCT user_id) AS users FROM events GROUP BY 1), (SELECT unnest([0.01, 0.02, 0.05]::DOUBLE[]) AS share)")
def required_sample_size(t):
    """Rows per arm to see a change of one, two or five in a hundred of each event type's mean."""
    s = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    s = s.withColumn("share", F.explode(F.array(F.lit(0.01), F.lit(0.02), F.lit(0.05))))
    return s.select("event_type", "share", X.required_sample_size(F.col("share") * F.col("mean"), F.col("sd")).alias("n"))


_PLAN = "(VALUES (0, 0.1::DOUBLE), (2, 0.25), (4, 0.5), (7, 1.0)) s(day, traffic)"


@query(f"WITH d AS (SELECT DISTINCT day(ts)::INT - 2 AS elapsed FROM events) SELECT elapsed, coalesce((SELECT max_by(traffic, day) FROM {_PLAN} WHERE day <= elapsed), 0.1) AS traffic FROM d")
def rollout_milestone(t):
    days = t.events.select((F.dayofmonth("ts") - 2).alias("elapsed")).distinct()
    return X.rollout_share(days, t.spark.sql("SELECT * FROM VALUES (0, 0.1D), (2, 0.25D), (4, 0.5D), (7, 1.0D) s(day, traffic)"))


@query(
    f"""WITH w AS ({_BY_TYPE}), d AS (SELECT event_type, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days FROM events GROUP BY 1)
    SELECT event_type, n_treatment >= 1000 AND days >= 3 AND abs(t) > 1.96 AND difference > 0 AS can_rollout,
      concat_ws(', ', CASE WHEN n_treatment < 1000 THEN 'has_min_samples' END, CASE WHEN days < 3 THEN 'has_min_runtime' END, CASE WHEN abs(t) <= 1.96 THEN 'is_significant' END, CASE WHEN difference <= 0 THEN 'has_positive_lift' END) AS failing
    FROM w JOIN d USING (event_type)"""
)
def rollout_readiness(t):
    days = t.events.groupBy("event_type").agg(F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("days"))
    w = X.welch(_sampled(t), ["event_type"]).join(days, "event_type")
    r = X.readiness(F.col("n_treatment"), F.col("days"), F.abs("t") > 1.96, F.col("difference"))
    return w.select("event_type", r["can_rollout"].alias("can_rollout"), r["failing"].alias("failing"))


@query(f"SELECT event_id, avg(value) OVER (PARTITION BY user_id, {_V} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_mean FROM events", ("running_mean",))
def bandit_running_mean(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "variant").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _sampled(t).select("event_id", F.avg("value").over(w).alias("running_mean"))


@query(f"WITH m AS (SELECT event_type, {_V} AS variant, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT event_id, CASE WHEN concat('0x', substr(md5(concat(event_id::VARCHAR, ':bandit')), 1, 8))::UBIGINT::DOUBLE / 4294967296 < 0.1 THEN {VARIANT.format(u='event_id::VARCHAR', e='explore')} ELSE (SELECT max_by(variant, mean) FROM m WHERE m.event_type = events.event_type) END AS chosen FROM events")
def bandit_selection(t):
    """Explores by hash, exploits the best mean so far of the event's type."""
    from ..functions.hashing import unit_interval

    best = _sampled(t).groupBy("event_type", "variant").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.max_by("variant", "m").alias("best"))
    explore = unit_interval(F.concat(F.col("event_id").cast("string"), F.lit(":bandit"))) < 0.1
    return t.events.join(best, "event_type").select("event_id", F.when(explore, X.variant(F.col("event_id"), "explore")).otherwise(F.col("best")).alias("chosen"))


@query(f"SELECT event_type, variant, avg(value) AS mean, count(*) AS n FROM (SELECT event_type, value, 'control' AS variant FROM events WHERE {_V} = 'control' UNION ALL SELECT event_type, value * 1.1, 'treatment' FROM events WHERE {_V} = 'control') GROUP BY 1, 2", ("mean",))
def shadow_compare(t):
    c = _sampled(t).filter("variant = 'control'").select("event_type", "value", "variant")
    shadow = c.withColumns({"value": F.col("value") * 1.1, "variant": F.lit("treatment")})
    return c.unionByName(shadow).groupBy("event_type", "variant").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


_KS = """
WITH s AS (SELECT lang, length(text) AS v, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS k FROM documents),
c AS (SELECT lang, v, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b FROM s GROUP BY 1, 2),
r AS (SELECT lang, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS n1, sum(b) OVER p AS n2 FROM c WINDOW w AS (PARTITION BY lang ORDER BY v), p AS (PARTITION BY lang))
SELECT lang, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(ca::DOUBLE / n1 - cb::DOUBLE / n2)) AS statistic FROM r GROUP BY 1"""


def _ks(t):
    s = t.documents.select("lang", F.length("text").alias("v"), (F.col("doc_id") % 2).cast("int").alias("k"))
    return X.ks_two_sample(s, ["lang"], "k", "v")


@query(_KS, ("statistic",))
def ks_drift(t):
    return _ks(t).drop("p")


@query()
def ks_pvalue(t):
    return _ks(t).withColumn("has_drift", (F.col("statistic") > 0.15) & (F.col("p") < 0.05))


_RUNS = "SELECT event_type AS metric, date_trunc('day', ts)::DATE AS day, avg(value) AS score FROM events GROUP BY 1, 2"
_Z = f"""
WITH r AS ({_RUNS}), b AS (SELECT metric, count(*) AS runs, avg(score) AS base, stddev_pop(score) AS sd FROM r WHERE day < DATE '2024-01-25' GROUP BY 1), c AS (SELECT metric, max_by(score, day) AS cur FROM r GROUP BY 1)
SELECT metric, runs, cur AS current_score, base AS baseline, (cur - base) / (sd + 1e-6) AS z, CASE WHEN runs < 3 THEN base - cur > 0.05 ELSE (cur - base) / (sd + 1e-6) < -1.6448536269514722 END AS is_regression FROM b JOIN c USING (metric)"""


@query(_Z, ("current_score", "baseline", "z"))
def zscore_regression(t):
    from ..operators import evaluation as V

    runs = t.events.groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    return V.z_regressions(runs.filter("day < '2024-01-25'"), runs.groupBy("metric").agg(F.max_by("score", "day").alias("current_score")))


@query()
def zscore_pvalue(t):
    return zscore_regression(t).withColumn("p", normal_sf(F.abs("z")))


@query(f"WITH r AS ({_RUNS}) SELECT r.metric, any_value(m.median - 2 * m.sd) AS threshold, avg((score < m.median - 2 * m.sd)::INT) AS expected_false_positives FROM r JOIN (SELECT metric, median(score) AS median, stddev_pop(score) AS sd FROM r GROUP BY 1) m ON r.metric = m.metric GROUP BY 1", ("threshold", "expected_false_positives"))
def threshold_calibration(t):
    runs = t.events.groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    bound = runs.groupBy("metric").agg((F.median("score") - 2 * F.stddev_pop("score")).alias("threshold"))
    return runs.join(bound, "metric").groupBy("metric").agg(F.first("threshold").alias("threshold"), F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("expected_false_positives"))
