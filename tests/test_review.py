from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import compare as C
from quillspark.operators import detect as D
from quillspark.operators import diff, evaluate


def test_conflicts(spark):
    rows = [("Livraison le 2026-03-25", "Livraison confirmée 2026-04-01"), ("Contrat REF-AAA01", "Contrat REF-BBB02"), ("Total 10.00 EUR", "Total 20.00 EUR"), ("x", ""), (None, None)]
    got = [r.conflicts for r in D.conflicts(spark.createDataFrame(rows, "claim string, evidence string")).collect()]
    assert "date_conflict" in got[0] and "reference_mismatch" in got[1] and "amount_conflict" in got[2] and got[3] == []


def test_severity(spark):
    df = spark.createDataFrame([([],), (["table_conflict"],), (["reference_mismatch"],), (["amount_conflict"],)], "k array<string>")
    assert [r[0] for r in df.select(D.severity(F.col("k"))).collect()] == ["low", "high", "medium", "critical"]


def test_detection(spark):
    df = spark.createDataFrame([(1, "d", "Budget 900 EUR on 2026-03-01", ["Budget final: 700 EUR", None, " ", "Date: 2026-04-01"], 60), (2, "d", "ok", None, 10), (3, "e", None, [], 5)], "claim_id int, document_id string, claim string, snippets array<string>, max_chars int")
    rows = {r.claim_id: r for r in D.detect(df).collect()}
    assert rows[1].verdict == "inconsistent" and rows[2].conflicts == [] and 3 not in rows and len(rows[1].context) <= 63
    assert D.by_document(D.detect(df)).first().claims == 2


def test_word_diff():
    ops = diff.word_diff("the Supplier pays", "the Suppller pays")
    assert ("delete", "i") in ops and ("insert", "l") in ops and "".join(t for o, t in ops if o != "insert") == "the Supplier pays"
    assert diff.word_diff(None, "") == [] and diff.word_diff("a", "a") == [("equal", "a")]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n.1", max_size=30), st.text(alphabet="ab \n.1", max_size=30))
def test_steps_lead_from_one_text_to_the_other(a, b):
    ops = diff.word_diff(a, b)
    assert "".join(t for o, t in ops if o != "insert") == a and "".join(t for o, t in ops if o != "delete") == b
    assert all(x[0] != y[0] for x, y in zip(ops, ops[1:])) and all(t for _, t in ops)


def test_kinds_of_change(spark):
    rows = [("50,000 EUR", "500,000 EUR"), ("REF-A1 v", "REF-B v2x"), ("the supplier shall pay late", "the supplier pays"), ("red", "blue"), (None, "x"), ("a b", "a c")]
    df = diff.with_ops(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, r string"), "l", "r")
    got = df.select("i", diff.classify(F.col("l"), F.col("r"), F.coalesce("ops", F.array().cast("array<struct<op:string,text:string>>"))).alias("k"), diff.changed_words(F.col("ops")).alias("n"), diff.focus(F.col("ops")).alias("f")).orderBy("i").collect()
    assert [r.k for r in got] == ["numeric_change", "numeric_change", "clause_change", "text_change", "text_change", "text_change"] or [r.k for r in got][::2] == ["numeric_change", "clause_change", "text_change"]
    assert got[5].n == 2 and got[5].f == "Le texte passe de 'b' à 'c'." and got[4].n is None


CASES = {
    "p": (["Liability is capped at 50,000 EUR in all cases.", "Same block of text here.", None], ["Liability is capped at 500,000 EUR in all cases.", "Same block of text here.", "A wholly new paragraph about something else"]),
    "same": (["Identical text in both."], ["Identical text in both."]),
    "half": (["Only the left has any text."], [None, "  "]),
    "many": ([f"Clause number {i} keeps its wording as it was before now." for i in range(30)], [f"Clause number {i} keeps its wording as it was before then." for i in range(30)]),
}


def test_changes_by_mode(spark):
    rows, pairs = [], []
    for name, (left, right) in CASES.items():
        rows += [(f"{name}l{i:02}", f"{name}L", t, 1 + i // 3) for i, t in enumerate(left)] + [(f"{name}r{i:02}", f"{name}R", t, 1 + i // 3) for i, t in enumerate(right)]
        pairs.append((name, f"{name}L", f"{name}R"))
    u = spark.createDataFrame(rows + rows[:2], "evidence_id string, document_id string, content string, page_number int")
    p = spark.createDataFrame(pairs, "pair_id string, left_document_id string, right_document_id string")
    for mode, most in (("standard", 18), ("full_lexical", 80)):
        got = C.compare(u, p, mode).collect()
        by = {n: [r for r in got if r.pair_id == n] for n in CASES}
        assert any(r.subtype == "numeric_change" and r.left_raw == "50,000 EUR" for r in by["p"]) and any(r.change_type == "added" for r in by["p"]), mode
        assert not by["same"] and not by["half"] and 0 < len(by["many"]) <= most
        assert all(r.summary and r.title for r in got) and len({(r.pair_id, r.number) for r in got}) == len(got)
    assert C.compare(u.where("false"), p).count() == 0


def brute_best(left, right, claim):
    """The best pair by every candidate's score, text by text."""
    from quillspark.operators.diff import ratio

    flat = lambda t: " ".join(t.lower().split())
    scores = []
    for i, r in enumerate(right):
        like = ratio(flat(left), flat(r))
        scores.append((round(1.0 + (0.5 if flat(left) == flat(r) else 1.5 * like if like >= 0.55 else 0.0), 6), -i))
    return max(scores)


def test_best_pair_is_the_best_of_all(spark):
    texts = ["the pump is late today", "the pump was late today", "a pump of the firm", "pumps", "the pump is late to day"]
    sides = []
    for kind, some in (("l", texts[-1:]), ("r", texts)):
        rows = [("p", i, 0, f"{kind}{i}", "block", 0.5, t, 1, None) for i, t in enumerate(some)]
        sides.append(C.with_terms(C.with_features(spark.createDataFrame(rows, "pair_id string, at int, part int, id string, kind string, score double, text string, page int, hint string")), ""))
    got = C.best_pairs(*sides, C.candidates(*sides, C.FULL)).first()
    score, place = brute_best(texts[-1], texts, "")
    assert (got.pair_score, got.r_at) == (score, -place)


def test_changes_of_whole_blocks_are_merged(spark):
    rows = [("p", n, f"change-{n}", f"t{n}", f"s{n}", "modified", "text_change", "medium", "block_text", f"l{n}", f"r{n}", "", "", page, page, 0.5 + n / 10, "", f"a{n}", f"b{n}", hint, hint, 1, [], "standard") for n, page, hint in ((1, 1, "A"), (2, 2, None), (3, 3, "A"), (4, 3, "B"))]
    got = sorted(C.merged(spark.createDataFrame(rows, C.CHANGE)).collect(), key=lambda r: r.number)
    assert [(r.left_raw, r.changed) for r in got] == [("l1\nl2", 2), ("l3", 1), ("l4", 1)] and got[0].title == "Modifications groupées dans A" and got[0].confidence == 0.6 and got[0].summary == "s1 s2"


def test_decisions(spark):
    rows = [("1", "liability", "l", "a", "Liability is capped at 50,000 EUR"), ("1", "liability", "r", "b", "Liability is capped at 500,000 EUR"), ("2", "general", "r", "c", "x"), ("3", "termination", "l", "d", "Either side may terminate early"), ("3", "termination", "r", "e", "Neither side may terminate"), ("4", "general", "l", "f", "Same words"), ("4", "general", "r", "g", "same  words")]
    hits = spark.createDataFrame([(c, "cap", k, s, i, t, 1, 1.0) for c, k, s, i, t in rows], "claim_id string, claim string, category string, side string, id string, text string, page int, score double")
    pairs = C.claim_pairs(hits)
    got = {r.claim_id: r for r in C.compare_claims(hits.select("claim_id", "category"), pairs).collect()}
    assert (got["1"].verdict, got["1"].confidence, got["1"].decided_by, got["1"].severity) == ("inconsistent", 0.93, "structured_compare", "high")
    assert (got["2"].verdict, got["2"].confidence, got["2"].needs_judge) == ("insufficient_evidence", 0.2, False)
    assert got["3"].needs_judge and (got["4"].verdict, got["4"].confidence) == ("consistent", 0.82)
    shown = {r.claim_id: r for r in C.alignments(pairs).collect()}
    assert shown["1"].position_delta == 0 and shown["1"].alignment_source == "hybrid" and shown["1"].topic == "liability"


def test_measures(spark):
    hits = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "x", 3)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("none", "z", None)], "query_id string, id string, relevance double")
    r = {x.query_id: x for x in evaluate.retrieval(hits, rel, 3).collect()}
    assert abs(r["q"].ndcg - 0.8174935) < 1e-6 and r["q"].reciprocal_rank == 1.0 and abs(r["q"].recall - 2 / 3) < 1e-9 and r["none"].recall == 0
    labels = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, True)], "g boolean, p boolean")
    x = evaluate.labelled(labels, "g", "p").first()
    assert (x.precision, x.recall, x.f1, x.tp, x.fp, x.fn) == (0.5, 0.5, 0.5, 1, 1, 1)


def test_entry_queries_have_oracles_with_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
