"""Cohorts, business figures, feature use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohort(plan: str, age: str, in_month: str, last_week: str, before_last: str) -> Column:
    """Ordered rules: power, new, at risk (down by more than 30 %), then the plan."""
    down = F.try_divide((F.col(before_last) - F.col(last_week)).cast("double"), F.col(before_last))
    return F.when(F.col(in_month) > 100, "power").when(F.col(age) <= 7, "new").when((F.col(before_last) > 0) & (down > 0.3), "at_risk").when(F.col(plan) == "enterprise", "enterprise").when(F.col(plan) == "paid", "paid").otherwise("free")


def cohort_by_trend(age: str, this_week: str, last_week: str, satisfaction: str, high: int = 50, low: int = 10) -> Column:
    """Ordered rules over use, age, trend and satisfaction."""
    use = F.col(this_week)
    trend = F.when(F.col(last_week) > 0, (use - F.col(last_week)) / F.nullif(F.col(last_week), F.lit(0))).otherwise(0.0)
    return (
        F.when((use > high) & (F.col(age) < 30), "new_power").when(use > high, "sustained_power").when(trend > 0.2, "growing").when((trend < -0.3) & (use >= low), "at_risk")
        .when((use < low) & (F.col(satisfaction) >= 4), "casual").when((use < low) & (F.col(satisfaction) < 3), "churning").otherwise("normal")
    )


def engagement(queries: Column, satisfaction: Column, features: Column) -> Column:
    return F.least(F.lit(100.0), queries / 20 * 30 + satisfaction / 5 * 50 + features / 5 * 20)


def per_user(df: DataFrame, group: str, user: str, amount: str) -> DataFrame:
    out = df.groupBy(group).agg(F.sum(amount).alias("cost"), F.count_distinct(user).alias("users"))
    return out.withColumn("cost_per_user", F.try_divide("cost", F.col("users").cast("double")))


def retention(weekly: DataFrame) -> DataFrame:
    """week, active, retained, retention of distinct (user_id, week): those active the week after."""
    after = weekly.select("user_id", F.date_sub("week", 7).alias("week"), F.lit(1).alias("_b"))
    return weekly.join(after, ["user_id", "week"], "left").groupBy("week").agg(F.count("*").alias("active"), F.count("_b").alias("retained")).withColumn("retention", F.col("retained") / F.col("active"))


def period_change(df: DataFrame, groups: Sequence[str], period: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*groups).orderBy(period))
    return df.withColumn("before", before).withColumn("change", F.when(F.col("before") > 0, (F.col(value) - F.col("before")) / F.col("before")))


def success_ema(events: DataFrame, groups: Sequence[str], keep: float = 0.95) -> DataFrame:
    """groups, n, as_is (moves on success only, so it never falls), corrected.

    Both moving averages in closed form: as_is depends on the number of
    successes alone, corrected weighs each by its place from the end.
    """
    last = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("ts"), F.desc("event_id")))
    ok = F.col("ok").cast("double")
    rows = events.withColumn("_w", ok * (1 - keep) * F.pow(F.lit(keep), last - 1))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), (1 - F.pow(F.lit(keep), F.sum(ok))).alias("as_is"), F.sum("_w").alias("corrected"))
