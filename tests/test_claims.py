"""Queries that hold claims against evidence, over small tables of their own."""

import re

import pytest

from quillspark.plans import search

CLAIM = "Within 29 days of every default licence, any verified cable shall be paid under clause 26.16."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("claims"))
    bundles = [(100, "own", CLAIM, ["x"], 500), (200, "own", "Pénalité de retard : 5 % selon l'article 7.", [None, "y"], 500), (300, "none", None, [], 500), (301, "own", "not asked", [], 500)]
    spark.createDataFrame(bundles, "bundle_id long, document_id string, claim string, snippets array<string>, max_chars int").write.parquet(f"{d}/context_bundles.parquet")
    texts = [("a", "own", "Any verified cable is paid under clause 26.16."), ("b", "own", "The default licence lasts."), ("c", "own", "Pénalité de retard : 5 %"), ("d", "far", "Within 29 days of every default"), ("e", "own", None)]
    texts += [(f"z{k:02}", f"far{k % 3}", f"{CLAIM} Copy {k}.") for k in range(60)]
    units = spark.createDataFrame([(*t, "text", 1, None, None, None) for t in texts], "evidence_id string, document_id string, content string, source_type string, page_number int, metadata map<string,string>, extracted_at timestamp, ingested_at timestamp")
    units.write.parquet(f"{d}/evidence_units.parquet")
    return d


def brute(how, claim, text):
    """The score of a text by the whole claim."""
    n, q = (" ".join(x.lower().split()) for x in (text, claim))
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    words = lambda t: re.findall("[a-z0-9]+", t)
    if how == "lexical":
        return 0.55 * len(grams(q) & grams(n)) / len(grams(q)) + 0.35 * sum(w in words(n) for w in words(q)) / len(words(q)) + 0.1 * (q in n)
    if how == "baseline":
        return 0.8 * len({*words(q)} & {*words(n)}) / len({*words(q)}) + 0.2 * (q in n)
    return sum(w in n for w in words(q)) / len(words(q))


@pytest.mark.parametrize("how", ["baseline", "lexical", "rg"])
def test_whole_claims_are_searched(spark, folder, how):
    claims = {r.query_id: r["query"] for r in search.claims(spark, folder).collect()}
    assert claims["100"] == CLAIM and len(claims) == 2
    texts = {r.id: r.text for r in search.corpus(spark, folder).collect() if r.text}
    got = search.QUERIES[f"search_{how}_topk"](spark, folder).collect()
    for q, claim in claims.items():
        hits = {r.id: r.score for r in got if r.query_id == q}
        scores = {i: round(brute(how, claim, t), 6) for i, t in texts.items()}
        assert hits == {i: pytest.approx(scores[i], abs=2e-6) for i in hits} and len(hits) == 10 if q == "100" else hits
        assert sorted(hits.values()) == pytest.approx(sorted(scores.values())[-len(hits) :], abs=2e-6)


def test_own_document_is_not_crowded_out(spark, folder):
    """Sixty copies of the claim stand in other documents; its own document gives its best three all the same."""
    claims, rows = search.claims(spark, folder), search.corpus(spark, folder)
    hits = search.R.keyword(rows, claims, 3, "baseline", "document_id").where("query_id = '100'").orderBy("rank").collect()
    assert [h.id for h in hits] == ["a", "b"]
    texts = {r.id: r.text for r in rows.collect() if r.text}
    assert {h.id: h.score for h in hits} == {h.id: pytest.approx(brute("baseline", CLAIM, texts[h.id]), abs=2e-6) for h in hits}
    grounded = search.grounded(spark, folder).collect()
    assert {(r.query_id, r.document_id, r.mode) for r in grounded} == {("100", "own", "index"), ("200", "own", "index")}
    assert search.R.keyword(rows, claims.where("false"), 3, "lexical", "document_id").count() == 0


def test_words_within_words(spark):
    """rg by words of the corpus against looking for each token in each text."""
    rows = [("a", "Résiliation 12-A abcdef"), ("b", "xabx ab b"), ("c", ""), ("d", None), ("e", "zz 1212")]
    asked = [("1", "ab"), ("2", "b b 12"), ("3", "siliation zzz"), ("4", "é"), ("5", "bcd a")]
    df, q = spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame(asked, "query_id string, query string")
    got = {(r.query_id, r.id): r.score for r in search.R.keyword(df, q, 9, "rg").collect()}
    want = {(i, d): pytest.approx(round(brute("rg", c, t), 6)) for i, c in asked for d, t in rows if t and re.findall("[a-z0-9]+", c) and brute("rg", c, t)}
    assert got == want


def test_short_queries_count_as_phrases(spark):
    rows = spark.createDataFrame([("a", "ab c"), ("b", "xaby")], "id string, text string")
    got = search.R.keyword(rows, spark.createDataFrame([("1", "AB")], "query_id string, query string"), 9).collect()
    assert [(r.id, r.score) for r in got] == [("a", 0.45)]
