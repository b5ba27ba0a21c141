"""Pattern-based personal data in chunks and logs: detect, whitelist, redact, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Entity, pattern, score.
PATTERNS = (
    ("EMPLOYEE_ID", r"\bEMP-\d{5}\b", 0.7),
    ("POLICY_NUMBER", r"\b(?:POL|POLICY)-\d{6}\b", 0.7),
    ("REFERENCE_CODE", r"\bREF-\d{4}-\d{4}\b", 0.6),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.85),
    ("US_SSN", r"\b\d{3}\s\d{2}\s\d{4}\b", 0.75),
    ("PHONE_NUMBER", r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", 0.8),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.8),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.6),
)
#: What stands in for an entity.
PLACEHOLDER = {"EMAIL_ADDRESS": "<EMAIL>", "PHONE_NUMBER": "<PHONE>", "US_SSN": "<SSN>", "EMPLOYEE_ID": "<EMP_ID>", "POLICY_NUMBER": "<POLICY>"}
#: Log masks, applied in this order.
LOG_MASKS = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b(\+\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    ("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
#: What is never personal.
WHITELIST = {"email_domains": ("example.com", "test.com", "localhost"), "ssn": ("123-45-6789", "000-00-0000", "111-11-1111"), "phone": ("(555) 555-5555", "555-1234")}


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = 0.0) -> DataFrame:
    """key, entity, match, score: one row per match of each pattern of that score or more."""
    each = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _entity(e, s)) for e, p, s in PATTERNS if s >= min_score]
    return docs.select(key, F.explode(F.flatten(F.array(*each))).alias("x")).select(key, "x.*")


#: Matches whose places are added up in one go: a list is copied for each place that is added to it, so long ones are added up block by block.
BLOCK = 128


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match stands, from the lengths of the gaps (one more than matches) and the matches."""
    steps = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(F.get(gaps, i).alias("gap"), F.length(F.get(found, i)).alias("n")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    inside = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"))
    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(all_, b * BLOCK + 1, BLOCK), first, inside))
    none = F.array().cast("array<struct<at:int,starts:array<int>>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    shifted = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b["starts"].alias("starts")))).alias("out"))
    done = F.aggregate(let(steps, blocks), start, shifted, lambda acc: F.flatten(F.transform(acc["out"], lambda b: F.transform(b["starts"], lambda s: b["at"] + s))))
    return F.when(F.size(found) > 0, done).otherwise(F.array().cast("array<int>"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", entities: tuple[str, ...] | None = None) -> DataFrame:
    """key, entity, start_at, end_at, score, match: where each match stands, in code points, end exclusive."""

    def of(entity: str, pattern: str, score: float) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(_starts(gaps, found), lambda at: F.zip_with(found, at, put(entity, score))))

    def put(entity: str, score: float):
        return lambda m, s: F.struct(F.lit(entity).alias("entity"), s.cast("long").alias("start_at"), (s + F.length(m)).cast("long").alias("end_at"), F.lit(score).alias("score"), m.alias("match"))

    each = [of(e, p, s) for e, p, s in PATTERNS if entities is None or e in entities]
    return docs.select(key, F.explode(F.flatten(F.array(*each))).alias("x")).select(key, "x.*")


def _entity(name: str, score: float):
    return lambda m: F.struct(F.lit(name).alias("entity"), m.alias("match"), F.lit(score).alias("score"))


def whitelisted(entity: Column, match: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"[\s\-()]", "")
    phones = [bare(F.lit(p)) for p in WHITELIST["phone"]]
    return (
        F.when(entity == "EMAIL_ADDRESS", F.element_at(F.split(match, "@"), -1).isin(*WHITELIST["email_domains"]))
        .when(entity == "US_SSN", match.isin(*WHITELIST["ssn"]))
        .when(entity == "PHONE_NUMBER", bare(match).isin(*phones))
        .otherwise(F.lit(False))
    )


def redact(text: Column, strategy: str = "replace") -> Column:
    """Patterns in their order; ``replace`` puts placeholders, ``mask`` stars, ``hash`` the kind and six digits of the match's MD5."""
    out = text
    for entity, pattern, _ in PATTERNS:
        if strategy == "replace":
            out = F.regexp_replace(out, pattern, PLACEHOLDER.get(entity, f"<{entity}>"))
        else:
            out = let(out, _rewritten(entity, pattern, strategy))
    return out


def _rewritten(entity: str, pattern: str, strategy: str):
    """The matches stand between the pieces that a split leaves."""
    return lambda x: F.array_join(F.zip_with(F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), _masked(entity, strategy)), "")


def _masked(entity: str, strategy: str):
    def put(gap: Column, m: Column) -> Column:
        if strategy == "mask":
            n = F.least(F.length(m), F.lit(4)) if entity == "EMAIL_ADDRESS" else F.length(m)
            new = F.concat(F.repeat(F.lit("*"), n), F.substring(m, n + 1, F.length(m)))
        else:
            new = F.concat(F.lit(f"<{entity}_"), F.substring(F.md5(m), 1, 6), F.lit(">"))
        return F.concat(gap, F.when(m.isNull(), "").otherwise(new))

    return put


def mask_log(line: Column) -> Column:
    for name, pattern in LOG_MASKS:
        line = F.regexp_replace(line, pattern, f"[{name}_REDACTED]")
    return line


def rejects(text: Column) -> Column:
    """Whether an upload is refused: a social security number or sixteen digits in a row."""
    return text.rlike(r"\d{3}-\d{2}-\d{4}|\d{16}")
