"""Controlled experiments: assignment, tests, corrections, rollout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import kolmogorov_p, student_p
from ..functions.hashing import unit_interval

MIN_SAMPLES = 1000


def variant(user: Column, experiment: str, split: float = 0.5) -> Column:
    """Deterministic assignment: below the split is treatment."""
    return F.when(unit_interval(F.concat(user.cast("string"), F.lit(f":{experiment}"))) < split, "treatment").otherwise("control")


def assign(users: DataFrame, existing: DataFrame, key: str, experiment: str, split: float = 0.5) -> DataFrame:
    """Idempotent: an assignment that exists (key, variant) stays, others are drawn. Adds ``variant`` and ``is_new``."""
    drawn = users.withColumn("_drawn", variant(F.col(key), experiment, split))
    out = drawn.join(existing.select(key, F.col("variant").alias("_had")), key, "left")
    return out.withColumn("variant", F.coalesce("_had", "_drawn")).withColumn("is_new", F.col("_had").isNull()).drop("_had", "_drawn")


def welch(samples: DataFrame, groups: Sequence[str], arm: str = "variant", value: str = "value") -> DataFrame:
    """Per group: sizes, means, difference (treatment less control), t, df, two-sided p; null with fewer than two values in an arm."""
    own = lambda a: F.when(F.col(arm) == a, F.col(value))
    stats = {}
    for a in ("control", "treatment"):
        x = own(a)
        stats |= {f"n_{a}": F.count(x), f"mean_{a}": F.avg(x), f"_v_{a}": F.var_samp(x)}
    out = samples.groupBy(*groups).agg(*[c.alias(n) for n, c in stats.items()])
    a, b = F.col("_v_treatment") / F.col("n_treatment"), F.col("_v_control") / F.col("n_control")
    diff = F.col("mean_treatment") - F.col("mean_control")
    ok = (F.col("n_treatment") >= 2) & (F.col("n_control") >= 2) & (a + b > 0)
    t = F.when(ok, diff / F.sqrt(a + b))
    df = F.when(ok, F.pow(a + b, 2) / (a * a / (F.col("n_treatment") - 1) + b * b / (F.col("n_control") - 1)))
    out = out.withColumn("difference", diff).withColumn("t", t).withColumn("df", df).drop("_v_control", "_v_treatment")
    return out.withColumn("p", student_p(F.col("t"), F.col("df")))


def paired(pairs: DataFrame, groups: Sequence[str], before: str, after: str) -> DataFrame:
    """Per group: n, mean difference, paired t, two-sided p."""
    d = F.col(after) - F.col(before)
    out = pairs.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"))
    out = out.withColumn("t", F.when((F.col("n") > 1) & (F.col("_s") > 0), F.col("mean_difference") / (F.col("_s") / F.sqrt("n")))).drop("_s")
    return out.withColumn("p", student_p(F.col("t"), F.col("n") - 1))


def _resampled(resamples: int, seed: int):
    """Sums of weights, and of weighted values, of each resample and arm: n equal values weigh Poisson(n) together, keyed by arm and value."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for arm, value, n in zip(*(batch.column(c).to_pylist() for c in ("arm", "value", "n"))):
                key = int.from_bytes(hashlib.blake2b(f"{seed}:{arm}:{value!r}".encode(), digest_size=8).digest(), "big")
                w = np.random.Generator(np.random.Philox(key)).poisson(n, resamples)
                have = sums.setdefault(arm, [np.zeros(resamples), np.zeros(resamples)])
                have[0] += w
                have[1] += w * value
        for arm, (w, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([arm] * resamples), pa.array(np.arange(resamples)), pa.array(w), pa.array(v)], ["arm", "b", "w", "v"])

    return run


def bootstrap_interval(samples: DataFrame, arm: str = "variant", value: str = "value", resamples: int = 10_000, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean difference by Poisson resampling.

    Equal values of an arm are counted first and resampled as one, so the
    work follows the distinct values; what leaves a task is ``resamples``
    sums for each arm, however many rows it read.
    """
    counted = samples.select(F.col(arm).cast("string").alias("arm"), F.col(value).cast("double").alias("value")).dropna().groupBy("arm", "value").agg(F.count("*").alias("n"))
    drawn = counted.mapInArrow(_resampled(resamples, seed), "arm string, b long, w double, v double")
    mean = lambda a: F.sum(F.when(F.col("arm") == a, F.col("v"))) / F.nullif(F.sum(F.when(F.col("arm") == a, F.col("w"))), F.lit(0.0))
    each = drawn.groupBy("b").agg((mean("treatment") - mean("control")).alias("d"))
    return each.agg(F.percentile("d", low).alias("ci_lower"), F.percentile("d", high).alias("ci_upper"))


def bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds ``corrected_alpha`` and ``significant``; one row per test, a table of experiments."""
    w = Window.partitionBy()
    return tests.withColumn("corrected_alpha", alpha / F.count(p).over(w)).withColumn("significant", F.col(p) < F.col("corrected_alpha"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", tie: str = "experiment_id") -> DataFrame:
    """Adds ``p_adjusted``: monotone, 1 at most; ties by name. One row per test."""
    up = Window.orderBy(F.col(p).asc_nulls_last(), tie)
    ranked = tests.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count(p).over(Window.partitionBy()))
    back = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back))).drop("_r", "_m")


def winner(p: Column, difference: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull() | (p >= alpha), "inconclusive").when(difference > 0, "treatment").otherwise("control")


def recommendation(won: Column, n_control: Column, n_treatment: Column, least: int = MIN_SAMPLES) -> Column:
    """The size is asked first."""
    return F.when((n_control < least) | (n_treatment < least), "keep_running").when(won == "inconclusive", "no_difference").when(won == "treatment", "roll_out").otherwise("keep_control")


def required_sample_size(effect: Column, sigma: Column | float, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """Rows per arm for a two-sided test of two means."""
    return F.ceil(2 * F.pow((z_alpha + z_power) * sigma / effect, 2))


def rollout_share(days: DataFrame, schedule: DataFrame, elapsed: str = "elapsed") -> DataFrame:
    """Adds ``traffic``: of the largest schedule day that has come, else of the first listed. ``schedule`` (day, traffic) is a rule table."""
    plan = schedule.agg(F.array_sort(F.collect_list(F.struct("day", "traffic"))).alias("plan"))
    out = days.join(F.broadcast(plan))
    reached = F.filter("plan", lambda x: x["day"] <= F.col(elapsed))
    return out.withColumn("traffic", F.coalesce(F.element_at(F.when(F.size(reached) > 0, reached), -1)["traffic"], F.col("plan")[0]["traffic"])).drop("plan")


def readiness(n_treatment: Column, days: Column, significant: Column, difference: Column, least: int = MIN_SAMPLES, least_days: int = 3) -> dict[str, Column]:
    """The four criteria, whether all hold, and which fail."""
    criteria = {"has_min_samples": n_treatment >= least, "has_min_runtime": days >= least_days, "is_significant": significant, "has_positive_lift": difference > 0}
    ready = F.lit(True)
    for c in criteria.values():
        ready = ready & c
    failing = F.array_join(F.array_compact(F.array(*[F.when(~c, n) for n, c in criteria.items()])), ", ")
    return criteria | {"can_rollout": ready, "failing": failing}


def ks_two_sample(samples: DataFrame, groups: Sequence[str], sample: str, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: groups, n1, n2, statistic, p. ``sample`` is 0 or 1.

    Values are counted first; the running sums go over distinct values.
    """
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.sum(F.when(F.col(sample) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(sample) == 1, 1).otherwise(0)).alias("b"))
    run = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*groups)
    c = counts.select(*groups, F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"), F.sum("a").over(every).alias("n1"), F.sum("b").over(every).alias("n2"))
    out = c.groupBy(*groups).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(F.abs(F.try_divide(F.col("ca").cast("double"), F.col("n1")) - F.try_divide(F.col("cb").cast("double"), F.col("n2")))).alias("statistic"))
    return out.withColumn("p", kolmogorov_p(F.col("statistic"), F.col("n1").cast("double"), F.col("n2").cast("double")))
