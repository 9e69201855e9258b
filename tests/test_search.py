import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import planner
from quillspark.operators import search as R

CORPUS = [("d1", "budget annuel 50 millions"), ("d2", "date de livraison 2026-03-25"), ("d3", "budget trimestriel 10 millions"), ("d4", None), ("d5", "")]


def corpus(spark, rows=CORPUS):
    return spark.createDataFrame(rows, "id string, text string")


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


def test_lexical_scores(spark):
    hits = R.keyword(corpus(spark), asked(spark, "budget millions", "", None), 2).collect()
    assert [(h.id, h.score) for h in sorted(hits, key=lambda h: h["rank"])] == [("d1", 0.857692), ("d3", 0.857692)]


def test_baseline_scores(spark):
    rows = [("a", "delivery deadline is 2026-01-10"), ("b", "budget approved amount is 1000 eur"), ("c", "deadline extension approved for delivery")]
    hits = R.keyword(corpus(spark, rows), asked(spark, "delivery deadline"), 5, "baseline").orderBy("rank").collect()
    assert [(h.id, h.score) for h in hits] == [("a", 1.0), ("c", 0.8)]


def test_regex_and_scan(spark):
    rows = [("a", "error: budget code is 900"), ("b", "error and budget mentioned but no number"), ("c", "budget only"), ("e", "Error code 500 on budget service")]
    df = corpus(spark, rows)
    index = R.trigram_index(df)
    assert [(r.id, r.score) for r in R.regex(df, r"error.*budget.*\d+", 5, index).collect()] == [("a", 1.0)]
    assert [(r.id, r.score) for r in R.regex(df, "Error.*500", 5, None, True).collect()] == [("e", 0.71875)]
    assert [(r.id, r.score) for r in R.regex(corpus(spark, [("a", "Budget annuel")]), "/budget/i", 5).collect()] == [("a", 0.838462)]
    assert R.regex(df, "budget(", 5, index).count() == 0


def test_plans():
    assert planner.plan("budget deadline").alternatives is None and not planner.plan("budget(").valid
    assert len(planner.plan(r"(budget|deadline)\s+2026").alternatives) == 2
    assert all("bu" not in a for a in planner.plan("budget|bucket").alternatives)
    assert planner.parse("delivery by 2026.")[0] and not planner.parse("  ")[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["abc", "de", "f.", "(gh|ijk)", "lmn?", "o+", "pq{2}", "[rs]", "t*u", r"\d", "(?:vwx)+", " yz "]), min_size=1, max_size=5), st.text(alphabet="abcdefghijklmnopqrstuvwxyz 0", max_size=60))
def test_plan_never_loses_a_match(parts, noise):
    pattern = "".join(parts)
    plan = planner.plan(pattern)
    sample = re.sub(r"[?*+{}()|\[\]\\.:]|\d", "", pattern) + noise
    for text in (sample, noise, noise + sample):
        if re.search(pattern, text) and plan.alternatives is not None:
            flat = " ".join(text.lower().split())
            own = {flat[i : i + 3] for i in range(len(flat) - 2)}
            assert any(a <= own for a in plan.alternatives)


def test_fusion(spark):
    sem = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.2, 2)], "query_id string, id string, score double, rank int")
    lex = spark.createDataFrame([("q", "c", 0.8, 2), ("q", "a", 0.3, 1)], "query_id string, id string, score double, rank int")
    out = R.fuse(sem, lex, 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in out] == [("a", 0.443238), ("c", 0.32504), ("b", 0.003105)] and out[0].sources == ["lexical", "semantic"]


def test_queries_do_not_meddle(spark):
    q = asked(spark, "budget millions", "livraison date", "10")
    whole = {tuple(r) for r in R.keyword(corpus(spark), q, 3).collect()}
    assert {tuple(r) for i in range(3) for r in R.keyword(corpus(spark), q.where(f"query_id = 'q{i}'"), 3).collect()} == whole and whole
    assert R.keyword(corpus(spark).where("false"), q).count() == 0 and R.keyword(corpus(spark), q.where("false")).count() == 0


def test_patterns_mean_the_same(spark):
    """What Python's expressions match is what the JVM is asked for: letters of any script, named groups, ends."""
    texts = [("a", "é1 ünd"), ("b", "x-x 7"), ("c", "end\nEND"), ("d", "[b]&&")]
    df = spark.createDataFrame(texts, "id string, text string")
    for pattern in (r"\bé\d\b", r"(?P<l>\w)-(?P=l)", r"END\Z", r"[[b]+\]", r"[]&]{2}", r"^\w\d", r"/^end/im", r"\w+\s\w+"):
        is_regex, plain, flags = planner.parse(pattern)
        want = {i for i, t in texts if re.search(plain, t, flags)}
        assert {r.id for r in R.regex(df, pattern, None).collect()} == want, pattern
    assert not planner.plan(r"(a)(?(1)b|c)").valid


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0])], "id string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.2])], "query_id string, vector array<double>")
    assert [r.id for r in R.nearest(v, q, 2).orderBy("rank").collect()] == ["a", "c"]
    many = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [0.0, 1.0])], "query_id string, vector array<double>")
    assert [(r.id, r.score) for r in R.late_interaction(v.where("id <> 'w'"), many, 2).orderBy("rank").collect()] == [("b", 2.0), ("c", 2.0)]


def test_encoder_and_strategies(spark):
    enc = {r.id: r.vector for r in R.encode_text(corpus(spark), "text", 16).collect()}
    assert abs(sum(x * x for x in enc["d1"]) - 1) < 1e-9 and set(enc["d4"]) == {0.0}
    assert R.run(spark, corpus(spark), asked(spark, "budget annuel"), "hybrid", 2).orderBy("rank").first().id == "d1"
    assert R.run(spark, corpus(spark), asked(spark, "budget annuel"), "semantic", 2).orderBy("rank").first().id == "d1"
