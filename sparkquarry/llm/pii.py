"""Personal data: base patterns, plus spans that gradient-boosted trees select among wide candidates.

DataFrame functions only.  Base spans are fixed by their patterns and checks.
For each kind a generator with high recall proposes further spans, and within
each, overlapping ones that leave out leading groups.  Boosted trees score
them by format and context.  No table marks personal data, so what is learnt
is made from the base spans: positives are base spans and what becomes of them
by a slip or a disguise that the base rules don't follow (a wrong digit, no
plus sign, other separators, "(at)" and "(dot)"), in the context where they
stand; negatives are dates, prices, ranges, chapters and numbers of other
lengths, in contexts from elsewhere in the documents.

The trees of a kind are fitted on ``MAX_DOCS`` documents of one half at most,
chosen by a hash among those with a base span of the kind, so a rare kind is
learnt as well as a frequent one.  All documents of the other half calibrate
them: the share of positives by score, made monotone.  The threshold is the
least score at which a candidate is right with the wanted probability.  Of the
candidates that overlap, the best stays; those over the threshold that overlap
no base span of their kind are added.

Patterns are written for linear scans: a run is entered at its beginning only,
and repetition of groups, which recurs on the stack, is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, discard, id_out, keyed, written

KINDS = ("email", "ip", "card", "phone")
#: Stands for a separator between two digits, or a dot between two label characters.
MARK = "\x01"
#: What the base patterns match, in a form without unbounded repetition of groups.
BASE = {
    # MARK stands for each dot between label characters
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # MARK stands for each single separator between digits; other counts of digits fail in any case
    "card": r"(?<![0-9\x01])[0-9](?:\x01?[0-9]){12,18}(?![0-9\x01])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20.()-]{1,3}[0-9]{2,4}){2,5}(?![0-9])",
}
CUE = {"email": r"(?i)mail|contact|write|schreib|courriel|correo", "ip": r"(?i)\bip\b|addr|host|server|login", "card": r"(?i)card|visa|credit|karte|carte|tarjeta|pay", "phone": r"(?i)phone|tel|call|mobil|fax|contact"}
SPAN = "array<struct<s:int,e:int,m:string,c:string>>"
#: Documents of a kind to learn from, trees, smallest weight of a leaf, probability that sets thresholds.
MAX_DOCS, ROUNDS, LEAF, PRECISION = 2_000, 12, 4.0, 0.95
#: Steps of scores in calibration; matches whose places are summed in one go.
STEPS, BLOCK = 200, 256
CLIP = 40


def spans(text: Column, pattern: str) -> Column:
    """Start and end (code points), match and what stands before it, of each match. The text between matches gives the places, summed block by block."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    none = F.array().cast(SPAN)

    def add(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["g"])
        e = s + F.length(z["m"])
        one = F.struct(s.alias("s"), e.alias("e"), z["m"].alias("m"), F.right(z["g"], F.lit(20)).alias("c"))
        return F.when(z["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    def block(acc: Column, zs: Column) -> Column:
        inner = F.aggregate(zs, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    cut = lambda zs: F.transform(F.sequence(F.lit(0), F.floor((F.size(zs) - 1) / BLOCK).cast("int")), lambda i: F.slice(zs, i * BLOCK + 1, BLOCK))
    blocks = F.flatten(F.transform(F.array(both), cut))
    return F.aggregate(blocks, first, block, lambda acc: F.flatten(acc["out"]))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the check."""
    d = F.transform(F.filter(F.split(F.reverse(digits(m)), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind, the base matches that pass their checks."""
    none = F.array().cast(SPAN)
    dotted = F.regexp_replace(F.translate(text, MARK, "\x02"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    digit = F.regexp_replace(F.translate(text, MARK, "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    some = text.rlike("[0-9]")
    small = lambda x: F.forall(F.split(x["m"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = lambda x: F.length(digits(x["m"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(dotted, BASE["email"])).otherwise(none),
        "ip": F.when(some, F.filter(spans(text, BASE["ip"]), small)).otherwise(none),
        "card": F.when(some, F.filter(spans(digit, BASE["card"]), lambda x: luhn(x["m"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans(text, BASE["phone"]), lambda x: (n(x) >= 9) & (n(x) <= 15))).otherwise(none),
    }


def wide_spans(text: Column) -> dict[str, Column]:
    """Of each kind, what the generator proposes; matches of a kind don't overlap each other."""
    none = F.array().cast(SPAN)
    some = text.rlike("[0-9]")
    at = F.contains(text, F.lit("@")) | text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]")
    found = {k: F.when(at if k == "email" else some, spans(text, WIDE[k])).otherwise(none) for k in KINDS}
    return found | {"phone": F.filter(found["phone"], lambda x: F.length(digits(x["m"])).between(7, 15))}


FEATURES = ("digits", "letters", "length", "groups", "dots", "dashes", "spaces", "brackets", "first group", "last group", "cue before", "letter before")


def features(kind: str, x: Column) -> Column:
    """Small integers that describe a candidate's format and context."""
    count = lambda p: F.length(x["m"]) - F.length(F.regexp_replace(x["m"], p, ""))
    parts = F.filter(F.split(x["m"], "[^A-Za-z0-9]+"), lambda p: p != "")
    size = lambda i: F.coalesce(F.length(F.get(parts, i)), F.lit(0))
    values = [
        count("[0-9]"), count("[A-Za-z]"), F.length(x["m"]), F.size(parts), count(r"\."), count("-"), count(r"\x20"), count(r"[()\[\]{}]"),
        size(F.lit(0)), size(F.size(parts) - 1), x["c"].rlike(CUE[kind]).cast("int"), x["c"].rlike(r"[A-Za-z0-9]$").cast("int"),
    ]
    return F.transform(F.array(*values), lambda v: F.least(v, F.lit(CLIP)))


@dataclass(frozen=True)
class Tree:
    """A split by one feature, and one below each side: (feature, bound) or None, and the values of the four leaves."""

    top: tuple[int, int]
    below: tuple[tuple[int, int] | None, tuple[int, int] | None]
    leaves: tuple[float, float, float, float]

    def value(self, f: Column) -> Column:
        def side(i: int) -> Column:
            cut, low, high = self.below[i], F.lit(self.leaves[2 * i]), F.lit(self.leaves[2 * i + 1])
            return low if cut is None else F.when(f[cut[0]] <= cut[1], low).otherwise(high)

        return F.when(f[self.top[0]] <= self.top[1], side(0)).otherwise(side(1))


@dataclass(frozen=True)
class Booster:
    base: float
    trees: tuple[Tree, ...]
    threshold: float

    def score(self, f: Column) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.value(f)
        return 1 / (1 + F.exp(-total))


def _best(rows: list, l2: float = 1.0) -> tuple[tuple[int, int] | None, float, float]:
    """The best split of (feature, value, gradient, curvature) sums, and the values of its two leaves."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["i"], []).append((r["v"], r["g"], r["h"]))
    if not by:
        return None, 0.0, 0.0
    g = sum(x[1] for x in by[0])
    h = sum(x[2] for x in by[0])
    best, found, low, high = 1e-6, None, g / (h + l2), g / (h + l2)
    for i, x in sorted(by.items()):
        gl = hl = 0.0
        for v, dg, dh in sorted(x)[:-1]:
            gl, hl = gl + dg, hl + dh
            if min(hl, h - hl) * 4 < LEAF:
                continue
            gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
            if gain > best:
                best, found, low, high = gain, (i, v), gl / (hl + l2), (g - gl) / (h - hl + l2)
    return found, low, high


def fit_booster(rows: DataFrame, rounds: int = ROUNDS, rate: float = 0.4) -> Booster | None:
    """Boosted trees of depth 2 over (f, y), not calibrated: nothing reaches the threshold.

    Each round groups gradients by feature and value, which is bounded by
    FEATURES x CLIP however many rows there are.  None if a class has fewer
    than five rows.
    """
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if any(total.get(y, 0) < 5 for y in (0, 1)):
        return None
    # a bounded sample: in one partition its sums need no shuffle, of which there are two for each tree
    train = rows.coalesce(1)
    share = total[1] / (total[0] + total[1])
    model = Booster(math.log(share / (1 - share)), (), 1.01)

    def sums(extra: list[Column]) -> list:
        p = model.score(F.col("f"))
        graded = train.select((F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), F.posexplode("f").alias("i", "v"), *extra)
        return graded.groupBy("i", "v", *["side"] * bool(extra)).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()

    for _ in range(rounds):
        top, _, _ = _best(sums([]))
        if top is None:
            break
        both = sums([(F.col("f")[top[0]] > top[1]).cast("int").alias("side")])
        sides = [_best([r for r in both if r["side"] == s]) for s in (0, 1)]
        tree = Tree(top, (sides[0][0], sides[1][0]), tuple(rate * v for s in sides for v in s[1:]))
        model = Booster(model.base, (*model.trees, tree), 1.01)
    return model


def calibrated(counts: list[tuple[int, int, int]], precision: float) -> float:
    """The least score from which a candidate is right with probability ``precision``, of (step, positives, rows).

    Neighbouring steps whose shares fall as the score rises are pooled, so
    that the shares are monotone.  1.01 if no step is good enough.
    """
    pools: list[list[float]] = []
    for step, good, n in sorted(counts):
        pools.append([step, good, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, g, m = pools.pop()
            pools[-1][1] += g
            pools[-1][2] += m
    return next((step / STEPS for step, good, n in pools if good >= precision * n), 1.01)


def disguised(kind: str, x: Column) -> Column:
    """Array of matches: a base span, and what becomes of it by a slip or a disguise."""
    m = x["m"]
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    tail = F.substring(m, F.length(m), F.lit(1)).cast("int")
    made = {
        "email": [F.concat(local, F.lit(" (at) "), F.regexp_replace(domain, r"\.", " (dot) ")), F.concat(local, F.lit("[at]"), F.regexp_replace(domain, r"\.", "[dot]"))],
        "ip": [F.regexp_replace(m, r"\.", ","), F.concat(m, F.lit("5"))],
        "card": [F.concat(F.substring(m, F.lit(1), F.length(m) - 1), ((tail + 1) % 10).cast("string")), F.regexp_replace(digits(m), r"(\d{4})(?=\d)", "$1.")],
        "phone": [F.substring(m, F.lit(2), F.length(m)), F.concat(F.lit("00"), F.substring(m, F.lit(2), F.length(m))), F.regexp_replace(m, r"^\+\d{1,2}[\x20-]", "")],
    }[kind]
    return F.array(m, *made)


def decoys(kind: str, key: Column) -> Column:
    """Array of what a generator would propose though it is none, with digits from a hash of ``key``."""
    n = lambda i, k: F.lpad(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(10**k)).cast("string"), k, "0")
    two = lambda i, top: F.lpad((F.pmod(F.xxhash64(key, F.lit(i)), F.lit(top)) + 1).cast("string"), 2, "0")
    year = lambda i: (F.pmod(F.xxhash64(key, F.lit(i)), F.lit(60)) + 1970).cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.array(*{
        "email": [put("meet (at) noon.", n(1, 2)), put("look [at] page ", n(2, 1), ".", n(3, 2)), put("x", n(4, 3), " (at) end.of.day"), put("sold {at} 3.", n(5, 2))],
        "ip": [put(n(1, 1), ",", n(2, 3), ",", n(3, 3), ",", n(4, 3)), put(n(5, 1), ",", n(6, 1), ",", n(7, 1), ",", n(8, 1)), put(two(9, 28), ".", two(10, 12), ".", year(11), ",", two(12, 23)), put(year(13), ".", year(14), ".", year(15), ".", year(16))],
        "card": [n(1, 12), put(year(2), two(3, 12), two(4, 28), two(5, 23), two(6, 59), two(7, 59)), put("978-", n(8, 1), "-", n(9, 3), "-", n(10, 5), "-", n(11, 1)), n(12, 18), put(year(13), "-", two(14, 12), "-", two(15, 28), " ", n(16, 6)), put(n(17, 3), ".", n(18, 3), ".", n(19, 3), ".", n(20, 3))],
        "phone": [put(year(1), "-", two(2, 12), "-", two(3, 28), " ", two(4, 23)), put(two(5, 28), ".", two(6, 12), ".", year(7), " ", two(8, 23)), put(year(9), "-", year(10), " ", year(11)), put(n(12, 3), ".", n(13, 3), ".", n(14, 3), ".", n(15, 3)), put(n(16, 4), " ", n(17, 4), " ", n(18, 4)), put(n(19, 4), "-", two(20, 12), "-", two(21, 28))],
    }[kind])


def lessons(docs: DataFrame, kind: str) -> DataFrame:
    """f, y: features and labels made from the base spans of ``docs`` (rid, text)."""
    rows = docs.select("rid", "text", base_spans(F.col("text"))[kind].alias("base")).filter(F.size("base") > 0)
    cell = lambda m, c: F.struct(m.alias("m"), c.alias("c"))
    good = F.flatten(F.transform("base", lambda x: F.transform(disguised(kind, x), lambda m: cell(m, x["c"]))))
    # a span's place in the list keys its decoys; their context is taken from a place of the text that a hash chooses
    place = lambda i: F.pmod(F.xxhash64("rid", i, F.lit(7)), F.greatest(F.length("text"), F.lit(1))).cast("int")
    bad = F.flatten(F.transform("base", lambda x, i: F.transform(decoys(kind, F.xxhash64("rid", i)), lambda m, j: cell(m, F.substring("text", place(i * 8 + j) + 1, F.lit(20))))))
    both = F.concat(F.transform(good, lambda x: F.struct(x.alias("x"), F.lit(1).alias("y"))), F.transform(bad, lambda x: F.struct(x.alias("x"), F.lit(0).alias("y"))))
    return rows.select(F.explode(both).alias("r")).select(features(kind, F.col("r.x")).alias("f"), F.col("r.y").alias("y"))


def train_boosters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, precision: float = PRECISION) -> dict[str, Booster | None]:
    """A booster for each kind, fitted on ``max_docs`` documents of one half at most and calibrated on all of the other half.

    A kind without base spans to learn from, or too few, has none.
    """
    half = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(2)).cast("int")
    texts = keyed(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]"))
    flags = [(F.size(b) > 0).alias(k) for k, b in base_spans(F.col("text")).items()]
    some = written(texts.select("rid", "text", half.alias("half"), *flags).filter(" or ".join(KINDS)), "pii")
    found: dict[str, Booster | None] = {}
    for k in KINDS:
        chosen = some.filter(F.col(k) & (F.col("half") == 0)).select("rid", "text").orderBy(F.xxhash64("rid"), "rid", F.xxhash64("text")).limit(max_docs)
        table = written(lessons(chosen, k), "lessons")
        model = fit_booster(table)
        discard(table)
        if model is not None:
            step = F.floor(F.get(F.transform(F.array("f"), model.score), F.lit(0)) * STEPS)
            seen = lessons(some.filter(F.col(k) & (F.col("half") == 1)), k).groupBy(step.alias("b")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
            model = Booster(model.base, model.trees, calibrated([(r["b"], r["p"], r["n"]) for r in seen], precision))
        found[k] = model
    discard(some)
    return found


def within(kind: str, x: Column) -> Column:
    """A candidate, and those that overlap it without its first one, two or three groups."""
    if kind == "email":
        return F.array(x)
    lead = lambda i: F.regexp_extract(x["m"], r"^(?:\+?\(?[0-9]+\)?[\x20.,()-]+){%d}" % i, 0)
    cut = lambda p: F.struct((x["s"] + F.length(p)).alias("s"), x["e"].alias("e"), F.substring(x["m"], F.length(p) + 1, F.length(x["m"])).alias("m"), F.right(F.concat(x["c"], p), F.lit(20)).alias("c"))
    least = {"ip": 4, "card": 12, "phone": 7}[kind]
    return F.concat(F.array(x), F.transform(F.filter(F.array(*[lead(i) for i in (1, 2, 3)]), lambda p: (p != "") & (F.length(digits(x["m"])) - F.length(digits(p)) >= least)), cut))


def _added(kind: str, base: Column, wide: Column, booster: Booster | None) -> Column:
    """The best candidate of each match, if it is over the threshold; none that overlaps a base span."""
    if booster is None or not booster.trees:
        return F.array().cast(SPAN)
    free = lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    # features are bound once: the trees refer to them dozens of times
    score = lambda y: F.get(F.transform(F.array(features(kind, y)), booster.score), F.lit(0))
    scored = lambda x: F.transform(F.filter(within(kind, x), free), lambda y: F.struct(score(y).alias("p"), (-y["s"]).alias("o"), y.alias("x")))
    best = F.transform(wide, lambda x: F.array_max(scored(x)))
    return F.transform(F.filter(best, lambda r: r["p"] >= booster.threshold), lambda r: r["x"])


def _joined(spans_of: dict[str, Column]) -> Column:
    def listed(kind: str, found: Column) -> Column:
        places = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        return F.transform(places, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    return F.array_join(F.concat(*[listed(k, c) for k, c in spans_of.items()]), ",")


def _found(rows: DataFrame, boosters: dict[str, Booster | None]) -> DataFrame:
    """rid, text, b_KIND and a_KIND: base and added spans of ``rows`` (rid, text)."""
    spanned = rows.select("rid", "text", *[c.alias(f"b_{k}") for k, c in base_spans(F.col("text")).items()], *[c.alias(f"w_{k}") for k, c in wide_spans(F.col("text")).items()])
    return spanned.select("rid", "text", *[f"b_{k}" for k in KINDS], *[_added(k, F.col(f"b_{k}"), F.col(f"w_{k}"), boosters.get(k)).alias(f"a_{k}") for k in KINDS])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boosters: dict[str, Booster | None] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per input row.

    Places are code points, the end is exclusive.  Null texts are empty and
    have no spans.  Repeated rows get the same result; a null id comes out
    null.  An empty table gives an empty result and trains nothing.
    """
    boosters = train_boosters(docs, id_col, text_col) if boosters is None else boosters
    found = _found(keyed(docs, id_col, text_col), boosters)
    base = {k: F.col(f"b_{k}") for k in KINDS}
    every = {k: F.concat(F.col(f"b_{k}"), F.col(f"a_{k}")) for k in KINDS}
    return found.select(
        id_out().alias("doc_id"), *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"),
    )


def redact(docs: DataFrame, boosters: dict[str, Booster | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets; spans that overlap go as one, under the first's kind.

    Spans are found in the very text that they are cut from, so rows that
    share an id can't be cut at each other's places.  A null text is empty.
    """
    boosters = train_boosters(docs, id_col, text_col) if boosters is None else boosters
    found = _found(keyed(docs, id_col, text_col), boosters)
    placed = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"))
    every = F.concat(*[F.transform(F.col(f"{c}_{k}"), placed(k)) for k in KINDS for c in "ba"])
    # the furthest end so far tells what is left of a gap; pieces are joined at the end
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring("text", acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), x["k"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    done = F.aggregate(F.array_sort(every), first, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))
    return found.select(id_out().alias("doc_id"), done.alias("text"))
