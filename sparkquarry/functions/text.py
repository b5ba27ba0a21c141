"""Text expressions; every one is a native column expression over a single row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that count as boilerplate.
BOILERPLATE = ("pursuant", "aforementioned", "hereinafter", "notwithstanding", "thereof", "hereby", "copyright", "reserved", "confidential")
SENTENCE_END = r"[.!?]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: higher-order functions repeat what stands in them."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-case words between white space; no empty ones."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column, longer_than: int = 0) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: F.length(s) > longer_than)


def ngrams(w: Column, n: int) -> Column:
    """Joined runs of ``n`` words; fewer words than ``n`` give none.

    Shifted copies are zipped: a lambda that sliced ``w`` would work it out anew for each run.
    """
    shifted = [F.slice(w, i + 1, F.greatest(F.size(w) - n + 1, F.lit(0))) for i in range(n)]
    joined = shifted[0]
    for s in shifted[1:]:
        joined = F.zip_with(joined, s, lambda x, y: F.concat(x, F.lit(" "), y))
    return joined


def ascii_ratio(text: Column) -> Column:
    """Null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.length(text))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def density_score(text: Column) -> Column:
    """100 x (1 - boilerplate share - repeated trigram share); 0 below ten words."""

    def score(w: Column) -> Column:
        boiler = F.size(F.filter(w, lambda x: x.isin(*BOILERPLATE))) / F.size(w)
        repeat = let(ngrams(w, 3), lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g))
        return F.when(F.size(w) < 10, 0.0).otherwise(clamp(100 * (1 - boiler - repeat)))

    return let(words(text), score)


def completeness_score(text: Column) -> Column:
    """0 without a sentence of more than ten characters; else 100, less 25 for each broken end, 10 more for two sentences, 100 at most."""
    score = 100.0 - F.when(text.rlike(r"^\p{Ll}"), 25.0).otherwise(0.0) - F.when(F.right(text, F.lit(1)).isin(".", "!", "?"), 0.0).otherwise(25.0)
    of = lambda n: F.when(n == 0, 0.0).otherwise(F.least(F.lit(100.0), score + F.when(n >= 2, 10.0).otherwise(0.0)))
    return let(F.size(sentences(text, 10)), of)


def readability_score(text: Column) -> Column:
    """Mean of a sentence length score and an encoding score; 0 without sentences."""

    def score(x: Column) -> Column:
        mean = x["words"] / F.nullif(x["n"], F.lit(0))
        by_length = F.when((mean >= 15) & (mean <= 25), 100.0).when(mean < 15, 80.0).otherwise(F.greatest(F.lit(0.0), 100 - (mean - 25) * 2))
        return F.when(x["n"] == 0, 0.0).otherwise((by_length + F.when(x["share"] > 0.95, 100.0).otherwise(x["share"] * 100)) / 2)

    return let(F.struct(F.size(sentences(text)).alias("n"), F.size(words(text)).alias("words"), ascii_ratio(text).alias("share")), score)


def metadata_score(required: list[Column], optional: list[Column]) -> Column:
    """80 points for the required fields, 20 for the optional ones; null and empty fields are missing."""
    there = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    total = lambda cs: sum((there(c) for c in cs), F.lit(0))
    return total(required) / len(required) * 80 + total(optional) / len(optional) * 20


def length_score(text: Column) -> Column:
    n = F.length(text)
    return F.when((n >= 200) & (n <= 800), 100.0).when(n < 200, n / 200 * 100).otherwise(F.greatest(F.lit(0.0), 100 - (n - 800) / 20))


#: Ordered: the first rule that holds decides; the first one minds the case.
def query_category(q: Column) -> Column:
    low = F.lower(q)
    has = low.contains
    return (
        F.when(q.startswith("What is"), "definition")
        .when(has("how does") | has("explain"), "explanation")
        .when(has("what are") & (has("requirements") | has("steps")), "procedural")
        .when(has("compare") | has("difference"), "comparison")
        .when(has("should") | has("recommend"), "recommendation")
        .otherwise("other")
    )


def access_level(path: Column, content: Column) -> Column:
    """The content is asked for one word only; the path for two."""
    path, content = F.lower(path), F.lower(content)
    return F.when(path.contains("confidential") | content.contains("confidential"), "confidential").when(path.contains("internal"), "internal").otherwise("public")
