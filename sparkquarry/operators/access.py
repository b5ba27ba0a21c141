"""Roles, policies, row filters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Role, resource, action.
POLICY = (
    ("admin", "confidential", "read"), ("admin", "confidential", "write"), ("admin", "internal", "read"), ("admin", "internal", "write"), ("admin", "public", "read"), ("admin", "public", "write"),
    ("editor", "internal", "read"), ("editor", "internal", "write"), ("editor", "public", "read"), ("editor", "public", "write"), ("viewer", "public", "read"), ("viewer", "internal", "read"),
)
#: A role, and the one whose permissions it has as well.
HIERARCHY = (("admin", "editor"), ("editor", "viewer"))


def policy(spark: SparkSession, rows=POLICY) -> DataFrame:
    return spark.createDataFrame(list(rows), "role string, resource string, action string")


def parse_policy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Policies and role edges of text lines (value): ``p, role, resource, action`` and ``g, role, inherits``; others are comments."""
    f = lines.select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("f"))
    p = f.filter((F.col("f")[0] == "p") & (F.size("f") == 4)).select(F.col("f")[1].alias("role"), F.col("f")[2].alias("resource"), F.col("f")[3].alias("action"))
    g = f.filter((F.col("f")[0] == "g") & (F.size("f") == 3)).select(F.col("f")[1].alias("role"), F.col("f")[2].alias("inherits"))
    return p, g


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("role", "inherits").agg(F.min("steps").alias("steps"))


def _reached(spark: SparkSession, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """role, inherits, steps (1 at least): the shortest way between each two roles that are linked; rows number as such pairs, whatever the ways between them."""
    known = stored(_nearest(edges.select("role", "inherits", F.lit(1).alias("steps"))), "roles")
    n = known.count()
    for _ in range(most_rounds):  # ways of up to twice the length each time
        on = known.select(F.col("role").alias("inherits"), F.col("inherits").alias("_to"), F.col("steps").alias("_more"))
        longer = known.join(on, "inherits").select("role", F.col("_to").alias("inherits"), (F.col("steps") + F.col("_more")).alias("steps"))
        # with no new pair no way gets shorter: a shorter one of twice the length would have shown its parts before
        known = stored(_nearest(known.unionByName(longer)), "roles")
        before, n = n, known.count()
        if n == before:
            return known
    raise RuntimeError("the role hierarchy did not settle")


def role_closure(spark: SparkSession, edges: DataFrame, roles: DataFrame) -> DataFrame:
    """role, inherits, steps: every role that one of ``roles`` reaches, by the shortest way, itself (0 steps) included; cycles do no harm."""
    own = roles.select("role", F.col("role").alias("inherits"), F.lit(0).alias("steps"))
    return _nearest(own.unionByName(_reached(spark, edges).join(roles.select("role").distinct(), "role", "left_semi")))


def role_cycles(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """role, cycle: for each role that inherits itself, the shortest way back to it; of several the first by name at each step."""
    known = _reached(spark, edges)
    closed = known.filter("role = inherits").select("role", "steps")
    # the next role on the shortest way from each role ("here") to the one that asks
    back = known.select(F.col("role").alias("next"), F.col("inherits").alias("role"), F.col("steps").alias("rest")).unionByName(closed.select(F.col("role").alias("next"), "role", F.lit(0).alias("rest")))
    ahead = edges.select(F.col("role").alias("here"), F.col("inherits").alias("next")).join(back, "next").join(closed.select("role"), "role", "left_semi")
    ahead = stored(ahead.groupBy("role", "here").agg(F.min(F.struct("rest", "next")).alias("s")).select("role", "here", "s.next"), "roles")
    names = [f"_{n}_{uuid.uuid4().hex}" for n in ("ahead", "closed")]
    ahead.createOrReplaceTempView(names[0])
    stored(closed, "roles").createOrReplaceTempView(names[1])
    most = closed.agg(F.max("steps")).first()[0] or 0
    return spark.sql(
        f"""WITH RECURSIVE c(role, here, path) MAX RECURSION LEVEL {most + 2} AS (
          SELECT c.role, a.next, array(c.role, a.next) FROM {names[1]} c JOIN {names[0]} a ON a.role = c.role AND a.here = c.role
          UNION ALL SELECT c.role, a.next, array_append(c.path, a.next) FROM c JOIN {names[0]} a ON a.role = c.role AND a.here = c.here WHERE c.here <> c.role)
        SELECT role, array_join(path, '>') AS cycle FROM c WHERE here = role"""
    )


def effective_permissions(closure: DataFrame, policies: DataFrame) -> DataFrame:
    """role, resource, action with inheritance; what isn't here is denied."""
    return closure.join(policies.withColumnRenamed("role", "inherits"), "inherits").select("role", "resource", "action").distinct()


def visible(documents: DataFrame, level: str, permissions: DataFrame, role: Column) -> DataFrame:
    """The documents a role may read; the filter can't be widened by the caller's own."""
    levels = permissions.filter((F.col("role") == role) & (F.col("action") == "read")).select(F.col("resource").alias(level)).distinct()
    return documents.join(levels, level, "left_semi")


def metadata_filter(spec: dict | None) -> Column:
    """A filter of metadata as a column: ``{k: v}``, ``{k: {"$eq": v}}``, ``{k: {"$in": [...]}}``, ``{"$and": [...]}``; several keys all count, null is no match, nothing lets all pass."""
    found = F.lit(True)
    for name, want in (spec or {}).items():
        if name == "$and":
            one = F.lit(True)
            for part in want:
                one = one & metadata_filter(part)
        elif isinstance(want, dict):
            if len(want) != 1 or next(iter(want)) not in ("$eq", "$in"):
                raise ValueError(f"unknown filter of {name}: {want}")
            (how, value), = want.items()
            one = F.col(f"`{name}`") == value if how == "$eq" else F.col(f"`{name}`").isin(*value)
        elif name.startswith("$"):
            raise ValueError(f"unknown filter {name}")
        else:
            one = F.col(f"`{name}`") == want
        found = found & F.coalesce(one, F.lit(False))
    return found


def secured(rows: DataFrame, server: dict, client: dict | None) -> DataFrame:
    """Rows that pass the server's filter and the caller's: a caller can narrow what they see, whatever they write."""
    return rows.filter(metadata_filter(server) & metadata_filter(client))


def key_owners(requests: DataFrame, users: DataFrame, key: str, key_hash: str, active: str) -> DataFrame:
    """``requests`` with the columns of the active user whose stored hash is that of the request's key; keys themselves are stored nowhere."""
    known = users.filter(F.col(active)).drop(active)
    return requests.withColumn(key_hash, F.sha2(F.col(key), 256)).drop(key).join(known, key_hash, "left").drop(key_hash)


def abac(user_dept: Column, doc_dept: Column, clearance: Column, sensitivity: Column) -> Column:
    return F.coalesce((user_dept == doc_dept) & (clearance >= sensitivity), F.lit(False))
