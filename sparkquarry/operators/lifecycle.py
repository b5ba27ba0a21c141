"""Experiments, roles, retention, prompts and golden sets as tables of events: the latest event of a key is its state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is added to a prompt for its most frequent complaint.
PROMPT_FIXES = {
    "Too verbose": "\n\nIMPORTANT: Be concise. Keep response under 200 words.",
    "Too technical": "\n\nIMPORTANT: Explain in simple terms. Avoid jargon.",
    "Missing context": "\n\nIMPORTANT: Provide context before answering.",
    "Wrong sources": "\n\nIMPORTANT: Only use information from provided sources.",
    "Incomplete answer": "\n\nIMPORTANT: Address all parts of the question.",
}
FIRST_PROMPT = "You are a helpful assistant."


def days_back(time: Column, as_of: Column, days: int) -> Column:
    """Whether ``time`` lies in the last ``days`` days before ``as_of``, the beginning rounded down to a day."""
    return (time >= F.date_trunc("day", as_of - F.make_dt_interval(F.lit(days))).cast("timestamp_ntz")) & (time <= as_of)


def latest(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key, by partial maxima, so a key with many events is no single task."""
    rest = [c for c in events.columns if c not in (*keys, *order)]
    top = events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, "_top.*")


def experiment_state(events: DataFrame) -> DataFrame:
    """experiment_id, status, split, stopped_at of events (experiment_id, seq, action, split, at): create, update and stop, in order of seq.

    The split is that of the last create or update; a stop ends an experiment
    until it is created again.
    """
    ran = F.col("action").isin("create", "update")
    last = F.max_by("action", "seq")
    s = events.groupBy("experiment_id").agg(last.alias("_a"), F.max_by("split", F.when(ran, F.col("seq"))).alias("split"), F.max_by("at", "seq").alias("_at"), F.count_if(F.col("action") == "update").alias("updates"))
    return s.select("experiment_id", F.when(F.col("_a") == "stop", "stopped").otherwise("running").alias("status"), "split", F.when(F.col("_a") == "stop", F.col("_at")).alias("stopped_at"), "updates")


def role_state(events: DataFrame) -> DataFrame:
    """user_id, role, version of those assigned: the last event of user and role decides, the version counts all events of the user."""
    held = latest(events, ["user_id", "role"], ["seq"]).filter("action = 'assign'").select("user_id", "role")
    return held.join(events.groupBy("user_id").agg(F.count("*").alias("version")), "user_id")


def check_log(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """One row for each check, granted or not: ``requests`` (any columns with role, resource, action)."""
    ok = permissions.select("role", "resource", "action").distinct().withColumn("granted", F.lit(True))
    return requests.join(ok, ["role", "resource", "action"], "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def retention(copies: DataFrame, as_of: Column, hours: Column) -> DataFrame:
    """Adds ``delete_at`` and ``drop``: copies whose time is over, but never the active one."""
    at = (F.col("replaced_at").cast("timestamp") + F.make_dt_interval(F.lit(0), hours)).cast("timestamp_ntz")
    return copies.withColumn("delete_at", at).withColumn("drop", F.coalesce((F.col("delete_at") <= as_of) & ~F.col("active"), F.lit(False)))


def next_prompt(versions: DataFrame, issues: DataFrame) -> DataFrame:
    """id, system_prompt of the version to append: the newest prompt with the fix for the most frequent issue (ties by name)."""
    fixes = F.create_map(*[F.lit(x) for pair in PROMPT_FIXES.items() for x in pair])
    counted = issues.groupBy("issue").agg(F.count("*").alias("n"))
    top = counted.agg(F.max_by("issue", F.struct("n", F.transform(F.split("issue", ""), lambda c: -F.ascii(c)))).alias("issue"))
    now = versions.agg(F.max("id").alias("id"), F.max_by("system_prompt", "id").alias("prompt"))
    text = F.concat(F.coalesce("prompt", F.lit(FIRST_PROMPT)), F.coalesce(F.element_at(fixes, F.col("issue")), F.lit("")))
    return now.join(top).select((F.coalesce("id", F.lit(0)) + 1).alias("id"), text.alias("system_prompt"))


def golden_additions(rated: DataFrame, order: Sequence[Column], most: int = 10) -> DataFrame:
    """The first ``most`` of the poorly rated; of those, the ones with a suggestion. The cut comes before the test, so fewer may be left."""
    return rated.orderBy(*order).limit(most).filter("coalesce(improvement, '') <> ''")


def delete_verified(table: DataFrame, gone: DataFrame, keys: Sequence[str], left: DataFrame) -> DataFrame:
    """What ``left`` holds after a deletion; raises where it still has a key of ``gone`` or lost another."""
    state = table.select(*keys, F.lit(True).alias("_was")).join(left.select(*keys, F.lit(True).alias("_is")), list(keys), "full").join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), list(keys), "left")
    is_, gone_ = F.coalesce("_is", F.lit(False)), F.coalesce("_gone", F.lit(False))
    said = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    stays = F.when(is_ & gone_, said("a deleted row is still there")).when(F.col("_was") & ~is_ & ~gone_, said("a row that stays is missing")).otherwise(is_)
    return state.filter(stays).select(*keys)


def cosine_report(pairs: DataFrame, score: str = "similarity", least: float = 0.75) -> DataFrame:
    """n, average_similarity, pass_rate (over ``least``) of generated answers beside what was expected."""
    return pairs.agg(F.count(score).alias("n"), F.avg(score).alias("average_similarity"), F.avg((F.col(score) > least).cast("double")).alias("pass_rate"))


def reranked(candidates: DataFrame, query: str, score: Column, tie: str, keep: int = 5) -> DataFrame:
    """The ``keep`` candidates of each query with the best ``score``, ties by ``tie``; the score is any column."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), tie)
    return candidates.withColumn("score", score).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def without_overlaps(chunks: DataFrame, document: str, number: str, start: str, end: str) -> DataFrame:
    """Chunks that no earlier chunk of the document, by start and then number, overlaps: the furthest end before tells."""
    w = Window.partitionBy(document).orderBy(start, number).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("_reach", F.max(end).over(w)).filter(f"_reach is null or _reach <= `{start}`").drop("_reach")
