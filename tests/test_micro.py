"""Hand-made rows with hand-derived results."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import distributions as DI
from sparkquarry.functions import text as T
from sparkquarry.operators import access as AC
from sparkquarry.operators import alerts as A
from sparkquarry.operators import audit as AU
from sparkquarry.operators import dedup as D
from sparkquarry.operators import evaluation as V
from sparkquarry.operators import experiments as X
from sparkquarry.operators import index as IX
from sparkquarry.operators import pii as P
from sparkquarry.operators import product as PR
from sparkquarry.operators import series as S
from sparkquarry.sources import files as FS


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_change_join(spark):
    prev = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 1), ("c", "h3", 1)], "doc_id string, hash string, mtime int")
    cur = spark.createDataFrame([("a", "h1", 1), ("b", "hX", 1), ("d", "h4", 1)], "doc_id string, hash string, mtime int")
    assert dict(map(tuple, IX.changes(cur, prev).collect())) == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}
    assert dict(map(tuple, IX.changes(cur, prev, mtime="mtime").collect()))["b"] == "unchanged"


@pytest.mark.parametrize(
    ("score", "text", "want"),
    [
        (T.density_score, "pursuant to the hereby copyright reserved one two three four five six seven eight", 100 * (1 - 4 / 14)),
        (T.density_score, "one two three four five six seven eight nine", 0),
        (T.completeness_score, "abc def ghi jkl mno", 50),
        (T.completeness_score, "This is one sentence. This is another one.", 100),
        (T.completeness_score, "", 0),
        (T.readability_score, " ".join(["word"] * 20) + ".", 100),
        (T.readability_score, " ".join(["word"] * 40) + ".", 85),
        (T.readability_score, "...", 0),
        (T.length_score, "x" * 100, 50),
        (T.length_score, "x" * 500, 100),
        (T.length_score, "x" * 1000, 90),
        (T.length_score, "x" * 2800, 0),
    ],
)
def test_scores(spark, score, text, want):
    assert one(spark, score(F.lit(text))) == pytest.approx(want)


def test_metadata_score(spark):
    a, none = F.lit("a"), F.lit(None).cast("string")
    assert one(spark, T.metadata_score([a, a, a], [none, none, F.lit("")])) == 80


def test_ngrams_are_guarded(spark):
    assert one(spark, T.ngrams(T.words(F.lit("a b")), 3)) == []
    assert one(spark, T.ngrams(T.words(F.lit(" a  b c d ")), 3)) == ["a b c", "b c d"]


def test_ks(spark):
    rows = [(0, x) for x in (85.0, 82.0, 88.0)] + [(1, x) for x in (65.0, 68.0, 70.0)]
    got = X.ks_two_sample(spark.createDataFrame(rows, "k int, v double"), [], "k", "v").first()
    assert got["statistic"] == 1
    rows = [(0, x) for x in (300.0, 350.0, 320.0)] + [(1, x) for x in (280.0, 310.0, 290.0)]
    assert X.ks_two_sample(spark.createDataFrame(rows, "k int, v double"), [], "k", "v").first()["statistic"] == pytest.approx(2 / 3)


def test_variant_and_distributions(spark):
    assert one(spark, X.unit_interval(F.lit("user_1:exp_001"))) == 0.11377144930884242
    assert one(spark, X.variant(F.lit("user_1"), "exp_001")) == "treatment"
    assert one(spark, DI.normal_sf(F.lit(1.959963984540054))) == pytest.approx(0.025, abs=1e-6)
    assert one(spark, DI.student_p(F.lit(2.228138852), F.lit(10.0))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, DI.student_p(F.lit(1.0), F.lit(1.0))) == pytest.approx(0.5, abs=1e-6)
    assert one(spark, DI.kolmogorov_p(F.lit(0.0), F.lit(5.0), F.lit(5.0))) == 1


def test_rollout(spark):
    plan = spark.createDataFrame([(0, 0.1), (2, 0.25), (4, 0.5), (7, 1.0)], "day int, traffic double")
    got = X.rollout_share(spark.createDataFrame([(-1,), (0,), (3,), (9,)], "elapsed int"), plan)
    assert dict((r["elapsed"], r["traffic"]) for r in got.collect()) == {-1: 0.1, 0: 0.1, 3: 0.25, 9: 1.0}


def test_roles(spark):
    edges = spark.createDataFrame(list(AC.HIERARCHY), "role string, inherits string")
    roles = spark.createDataFrame([("admin",), ("editor",), ("viewer",)], "role string")
    perms = {tuple(r) for r in AC.effective_permissions(AC.role_closure(spark, edges, roles), AC.policy(spark)).collect()}
    assert ("viewer", "internal", "read") in perms and ("viewer", "confidential", "read") not in perms and ("editor", "public", "read") in perms
    loop = spark.createDataFrame([("admin", "editor"), ("editor", "viewer"), ("viewer", "admin")], "role string, inherits string")
    assert "admin>editor>viewer>admin" in {r["cycle"] for r in AC.role_cycles(spark, loop).collect()}
    assert AC.role_cycles(spark, edges).isEmpty()
    lines = spark.createDataFrame([("# c",), ("p, a, b, read",), ("g, a, c",), ("",)], "value string")
    p, g = AC.parse_policy(lines)
    assert [tuple(r) for r in p.collect()] == [("a", "b", "read")] and [tuple(r) for r in g.collect()] == [("a", "c")]


def test_access_level(spark):
    assert one(spark, T.access_level(F.lit("docs/internal/x"), F.lit("Confidential note"))) == "confidential"
    assert one(spark, T.access_level(F.lit("docs/internal/x"), F.lit("a"))) == "internal"
    assert one(spark, T.access_level(F.lit("docs/x"), F.lit("internal"))) == "public"


def test_pii(spark):
    assert one(spark, P.mask_log(F.lit("(555) 123-4567"))) == "([PHONE_REDACTED]"
    assert one(spark, P.redact(F.lit("my 123-45-6789"), "replace")) == "my <SSN>"
    a = one(spark, P.redact(F.lit("123-45-6789 x 123-45-6789"), "hash")).split(" x ")
    assert a[0] == a[1] and a[0].startswith("<US_SSN_")
    assert one(spark, P.redact(F.lit("see EMP-12345."), "mask")) == "see *********."
    skip = lambda e, m: one(spark, P.whitelisted(F.lit(e), F.lit(m)))
    assert skip("EMAIL_ADDRESS", "a@example.com") and skip("PHONE_NUMBER", "(555)555-5555") and not skip("US_SSN", "123-45-6780")


def test_audit(spark):
    assert one(spark, AU.canonical({"b": F.lit("1"), "a": F.lit("2")})) == '{"a": "2", "b": "1"}'
    exp = lambda c, d: one(spark, AU.expiry(F.lit(c), F.date_sub(F.lit("2024-12-31").cast("date"), d), F.lit("2024-12-31")))
    assert exp("internal", 366) and not exp("internal", 364) and exp(None, 366) and exp("public", 91) and not exp("restricted", 2000)
    log = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "c", "X")], "i int, content_hash string, previous_hash string").withColumn("s", F.lit(0))
    assert [r["link_ok"] for r in AU.verified(log, ["s"], ["i"]).orderBy("i").collect()] == [True, True, False]


def test_cohorts(spark):
    row = spark.createDataFrame([("free", 2, 101, 1, 1, 5, 5, 3.5)], "plan string, age int, m int, l int, b int, t int, lw int, s double")
    assert row.select(PR.cohort("plan", "age", "m", "l", "b")).first()[0] == "power"
    assert row.select(PR.cohort_by_trend("age", "t", "lw", "s")).first()[0] == "normal"
    assert one(spark, PR.engagement(F.lit(10), F.lit(4.2), F.lit(3))) == pytest.approx(69)


def _alerts(spark, rows):
    return spark.createDataFrame(rows, "event_id int, s int, name string, severity string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")


def test_incidents_and_dedup(spark):
    a = _alerts(spark, [(1, 0, "CacheMissRate", "warning"), (2, 30, "QueryTimeout", "critical"), (3, 60, "HighVectorDBLatency", "info"), (4, 360, "QueryTimeout", "info")])
    got = A.incidents(a, 300).orderBy("created_at").collect()
    assert [(r["n_alerts"], r["severity"]) for r in got] == [(3, "critical"), (1, "info")]
    d = _alerts(spark, [(1, 0, "x", "info"), (2, 240, "x", "info"), (3, 360, "x", "info")])
    assert {r["event_id"]: r["is_duplicate"] for r in A.deduplicated(d, ["name"], 300).collect()} == {1: False, 2: True, 3: False}


def test_counter_resets(spark):
    df = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate((10, 15, 3, 8))], "event_id int, ts int, value double").withColumn("k", F.lit(1))
    assert S.increases(df, ["k"]).agg(F.sum("delta")).first()[0] == 13


def test_quantile_of_nothing_and_infinity(spark):
    df = spark.createDataFrame([(1, 500.0)], "k int, value double")
    assert S.bucket_quantile(S.bucket_counts(df, ["k"], (1.0, 10.0)), ["k"], 0.5).first()["quantile"] == 10
    assert S.bucket_quantile(S.bucket_counts(df.filter("k = 2"), ["k"], (1.0,)), ["k"], 0.5).isEmpty()


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(10)], "k int, value double")
    assert S.nearest_rank(df, ["k"], 0.95).first()["nearest_rank"] == 9


def test_evaluation(spark):
    scores = {"faithfulness": 0.45, "answer_relevancy": 0.82, "context_precision": 0.76, "context_recall": 0.71}
    assert one(spark, V.overall({k: F.lit(v) for k, v in scores.items()})) == pytest.approx(0.6435)
    mk = lambda d: spark.createDataFrame(list(d.items()), "metric string, score double")
    got = {r["metric"]: r["verdict"] for r in V.against_baseline(mk({"a": 0.72, "b": 0.81, "new": 0.5}), mk({"a": 0.85, "b": 0.82})).collect()}
    assert got == {"a": "regression_high", "b": "stable", "new": "improvement"}
    assert V.against_thresholds(mk(scores), "compliance").filter("metric = 'faithfulness'").first()["severity"] == "critical"
    b = spark.createDataFrame([(1, 0.8, 20), (1, 0.5, 10)], "g int, score double, n int")
    assert V.weighted_merge(b, ["g"]).first()["score"] == pytest.approx(0.7)


def test_alpha(spark):
    mk = lambda rows: V.ordinal_alpha(spark.createDataFrame(rows, "unit int, rating int")).first()["alpha"]
    counts = {(0, 0): 49, (0, 1): 9, (1, 0): 299, (1, 1): 42}
    rows = [(i, r) for i, (q, t) in enumerate((q, t) for (q, t), n in counts.items() for _ in range(n)) for r in (q, 1 - t)]
    assert mk(rows) == pytest.approx(0.034274, abs=1e-6)
    assert mk([(1, 1), (1, 1), (2, 3), (2, 3)]) == 1


def test_bh(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "experiment_id string, p double")
    assert [round(r["p_adjusted"], 9) for r in X.benjamini_hochberg(t).orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_costs(spark):
    gb, dollars = IX.storage_cost(F.lit(500_000), F.lit(1536))
    assert one(spark, gb) == pytest.approx(3.43, abs=0.01) and one(spark, dollars) == pytest.approx(1.03, abs=0.01)
    assert IX.backoff(8) == [1, 2, 4, 8, 16, 32, 60, 60] and math.isclose(sum(IX.backoff(2)), 3)


def test_similar_pairs_and_greedy(spark):
    from sparkquarry.sources.shared import ensure_checkpoints

    ensure_checkpoints(spark)
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "a b c d e f g h i k l m", "", "z", None, "a b c d e f g h i j"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pairs = D.similar_pairs(D.token_sets(df), 0.7)
    sets = [set((t or "").split()) for t in texts]
    want = {(i, j) for i in range(7) for j in range(i + 1, 7) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    got = {r["doc_id"]: r["duplicate_of"] for r in D.greedy(df, pairs).collect()}
    assert got == {0: None, 1: 0, 2: None if (0, 2) not in want else 0, 3: None, 4: None, 5: None, 6: 0}


def _overlapping(n, seed):
    r = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        base = set(r.integers(0, 400, r.integers(1, 200)).tolist()) if not texts or r.random() < 0.3 else set(texts[r.integers(len(texts))])
        for _ in range(r.integers(0, 1 + len(base) // 8)):
            base ^= {int(r.integers(0, 400))}
        texts.append(sorted(base))
    return texts


def test_sets_beside_brute_force(spark):
    """Sets of one to two hundred words from a vocabulary of 400: no pair is lost, and copies make no pairs for the greedy order."""
    from sparkquarry.sources.shared import ensure_checkpoints

    ensure_checkpoints(spark)
    texts = _overlapping(250, 4)
    df = spark.createDataFrame([(i, " ".join(map(str, t))) for i, t in enumerate(texts)], "doc_id long, text string")
    sim = lambda i, j: len(set(texts[i]) & set(texts[j])) / len(set(texts[i]) | set(texts[j])) if texts[i] and texts[j] else 0.0
    want = {(i, j) for i in range(250) for j in range(i + 1, 250) if sim(i, j) >= 0.85}
    assert {(r["a"], r["b"]) for r in D.similar_pairs(D.token_sets(df), 0.85).collect()} == want and len(want) > 200
    kept, of = [], {}
    for i in range(250):
        near = [(-sim(j, i), j) for j in kept if (j, i) in want]
        of[i] = min(near)[1] if near else None
        if not near:
            kept.append(i)
    assert {r["doc_id"]: r["duplicate_of"] for r in D.greedy_sets(df, D.token_sets(df), 0.85).collect()} == of


def test_frequent_words_make_few_candidates(spark):
    """400 sets of 60 of 150 words, none similar: by single words they nearly all met."""
    r = np.random.default_rng(1)
    rows = [(i, r.permutation(150)[:60].tolist()) for i in range(400)]
    sets = D.token_sets(spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in rows], "doc_id long, text string"))
    of = D.segments_of(sets.select(F.col("doc_id").alias("rep"), F.col("tokens").alias("t")), 0.85)
    met = of.filter("home").groupBy("segment").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert met < 800  # of 79,800 pairs


def test_groups_by_signatures(spark, tmp_path, monkeypatch):
    """Groups of long documents are those of all pairs; what is stored for them is small beside their tokens, and is gone afterwards."""
    from sparkquarry.plans import catalogue

    r, sizes = np.random.default_rng(7), []
    texts = [r.integers(0, 10**6, 1500).tolist() for _ in range(300)]
    for i in range(300, 340):
        texts.append([int(x) for x in texts[i - 300 if i < 320 else i - 20]])
        texts[-1][:: 8 if i % 2 else 40] = r.integers(0, 10**6, len(texts[-1][:: 8 if i % 2 else 40])).tolist()
    texts += [texts[5], [], [], ["\n"]]
    lang = ["en" if i != 340 else "de" for i in range(len(texts))]
    df = spark.createDataFrame([(i, " ".join(map(str, w)), c) for i, (w, c) in enumerate(zip(texts, lang))], "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    sets = [{*" ".join(map(str, w)).split(), f"section:{c}"} for w, c in zip(texts, lang)]
    group = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
    while any(group[i] != group[j] for i, j in pairs):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])

    def weighed(df, name, put=D.stored):
        found = put(df, name)
        sizes.append(sum(p.stat().st_size for f in found.inputFiles() for p in [Path(f.removeprefix("file:").replace("///", "/"))]))
        return found

    monkeypatch.setattr(D, "stored", weighed)
    before = {*Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    got = catalogue.queries()["near_duplicates_minhash"](spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["group"] for x in got} == dict(enumerate(group)) and 20 < len(pairs)
    left = {p.name.rsplit("-", 1)[0] for p in {*Path(spark.conf.get("spark.checkpoint.dir")).iterdir()} - before}
    assert max(sizes) < 0.3 * 8 * sum(map(len, sets)) and left <= {"members", "labels"}


def test_sketches_of_large_sets(spark):
    """Sets of up to 6000 tokens: similar ones are allowed, whatever the lengths of their sketches; others are not."""
    r, rows, pairs = np.random.default_rng(2), [], []
    for n in [1, 7, 200, 900, 1000, 1024, 1025, 1100, 2000, 2048, 2049, 2200, 4000, 4096, 4200, 6000]:
        base = r.integers(-(2**63), 2**63, n).tolist()
        rows += [base, base[: -(-n * 85 // 100)], r.integers(-(2**63), 2**63, n).tolist()]
        pairs += [(len(rows) - 3, len(rows) - 2, True), (len(rows) - 3, len(rows) - 1, False), (len(rows) - 2, len(rows) - 1, False)]
    made = D.sketches_of(spark.createDataFrame(list(enumerate(rows)), "rep int, t array<long>")).collect()
    both = spark.createDataFrame([(made[i]["n"], made[j]["n"], made[i]["sketch"], made[j]["sketch"], like) for i, j, like in pairs], "na long, nb long, sa array<long>, sb array<long>, like boolean")
    assert both.filter(D._sketches_allow(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), 0.85) != F.col("like")).isEmpty()


def test_marks_keep_every_row(spark):
    some = spark.range(0, 3_000_000, 10_007).select(F.col("id").alias("rep"))
    rows = spark.range(3_000_000).select(F.col("id").alias("k"))
    got = D.marked(rows, "k", some)
    assert got.join(some, F.col("k") == F.col("rep"), "left_semi").count() == some.count() <= got.count() < 2 * some.count()
    assert D.marked(rows, "k", some.limit(0)).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("x")
    (tmp_path / "d" / "e" / "b.md").write_text("y")
    (tmp_path / "d" / "c.bin").write_text("z")
    assert FS.scan_documents(spark, str(tmp_path / "d")).count() == 2
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    m = FS.backup(df, str(tmp_path / "b"), "id")
    assert FS.restore(spark, str(tmp_path / "b"), df.schema, "id", m).count() == 10
    with pytest.raises(ValueError, match="manifest"):
        FS.restore(spark, str(tmp_path / "b"), df.schema, "id", FS.manifest(df.limit(3), "id"))
    assert FS.read_state(spark, str(tmp_path / "none"), df.schema).isEmpty()
    bad = FS.append_events(df.withColumn("ts", F.lit("2024-01-02").cast("timestamp")), str(tmp_path / "log"), F.col("v") < 10)
    assert bad.count() == 5 and spark.read.json(str(tmp_path / "log")).count() == 5
    one_ = spark.createDataFrame([(1, '[{"completed_by": 7, "result": [{"from_name": "helpful", "value": {"choices": ["yes", "no"]}}]}]')], "q int, j string")
    assert FS.parse_annotations(one_, "q", "j").count() == 2


def _counted(monkeypatch):
    """Rows of the tables that a query stores, by name."""
    rows = {}

    def counted(df, name, put=D.stored):
        found = put(df, name)
        rows.setdefault(name, []).append(found.count())
        return found

    monkeypatch.setattr(D, "stored", counted)
    return rows


def _near_copies(tmp_path, spark):
    """240 near copies of one text, a few of them copies, in two languages; some lack one, and each lacks two of 200 words and has one of its own."""
    r = np.random.default_rng(11)
    sets = [set(range(200)) - set(r.integers(0, 200, 2).tolist()) | {1000 + i} for i in range(240)]
    sets += [sets[3], sets[3], sets[7]]
    lang = [None if i % 50 == 9 else "en" if i % 3 else "de" for i in range(len(sets))]
    rows = [(i, " ".join(map(str, sorted(s))), c, "src") for i, (s, c) in enumerate(zip(sets, lang))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    return {p: s for p, s in pairs.items() if s >= 0.85}, lang


def test_near_copies_are_counted_in_blocks(spark, tmp_path, monkeypatch):
    """Before their pairs are counted, 240 near copies make rows of tables with their number (28,000 pairs were stored, each with both token lists shuffled)."""
    from sparkquarry.plans import catalogue

    want, _ = _near_copies(tmp_path, spark)
    rows = _counted(monkeypatch)
    monkeypatch.setattr(D, "CELL_SETS", 100, raising=False)
    monkeypatch.setattr(D, "MATRIX", (40, 64), raising=False)
    got = {(x["a"], x["b"]): x["similarity"] for x in catalogue.queries()["jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 28_000
    assert max(n for name in rows for n in rows[name] if name not in ("pairs", "buckets")) < 240 * 20 and sum(rows["buckets"]) < 240 * 80


def test_fields_are_asked_where_pairs_are_made(spark, tmp_path, monkeypatch):
    """Of near copies in two languages, some in none: pairs of one language; the list of all pairs isn't joined with the fields afterwards."""
    from sparkquarry.plans import catalogue

    want, lang = _near_copies(tmp_path, spark)
    asked = []
    monkeypatch.setattr(D, "expanded", lambda *a, put=D.expanded, **k: asked.append(put(*a, **k)) or asked[0])
    got = {(x["a"], x["b"]): x["similarity"] for x in catalogue.queries()["date_aware_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): s for (a, b), s in want.items() if lang[a] == lang[b] and lang[a] is not None} and 10_000 < len(got) < len(want)
    assert asked[0].count() == len(got)


def test_greedy_order_of_near_copies(spark, tmp_path, monkeypatch):
    """Near copies of one text: those that go are found without a table of their pairs but the one, and nothing is left behind but what the result reads."""
    from sparkquarry.plans import catalogue

    want, lang = _near_copies(tmp_path, spark)
    before = {*Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    rows, kept, of = _counted(monkeypatch), [], {}
    for i in range(len(lang)):
        near = [(-want[j, i], j) for j in kept if (j, i) in want]
        of[i] = min(near)[1] if near else None
        if not near:
            kept.append(i)
    got = catalogue.queries()["greedy_dedup"](spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["duplicate_of"] for x in got} == of
    assert max(n for name in rows for n in rows[name] if name not in ("pairs", "buckets")) < 240 * 20
    left = {p.name.rsplit("-", 1)[0] for p in {*Path(spark.conf.get("spark.checkpoint.dir")).iterdir()} - before}
    assert left <= {"members", "pairs", "state"}
