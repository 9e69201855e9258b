"""Queries that ask every claim, over small tables in which no bundle id is divisible by 100."""

import __spark_entry__
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("every"))
    claims = [(1, "a", "The cable is paid under clause 26."), (7, "b", "Pénalité de retard"), (150, "c", "Any default licence lasts 29 days"), (151, "c", None)]
    spark.createDataFrame([(*c, ["x"], 500) for c in claims], "bundle_id long, document_id string, claim string, snippets array<string>, max_chars int").write.parquet(f"{d}/context_bundles.parquet")
    texts = [(f"{doc}:1", doc, f"{claim} - indeed") for _, doc, claim in claims if claim] + [("d:1", "d", "nothing of it"), ("d:2", "d", None)]
    units = [(*t, "text", 1, None, None, None) for t in texts]
    spark.createDataFrame(units, "evidence_id string, document_id string, content string, source_type string, page_number int, metadata map<string,string>, extracted_at timestamp, ingested_at timestamp").write.parquet(f"{d}/evidence_units.parquet")
    return d


def asked(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder).collect()


def test_best_strategy_of_every_claim(spark, folder):
    assert [tuple(r) for r in asked(spark, folder, "evl_best_strategy")] == [("baseline", 1.0)]


def test_keyword_strategies_over_every_claim(spark, folder):
    got = {r.strategy: (r.queries, r.recall, r.mrr) for r in asked(spark, folder, "evl_keyword_strategies")}
    assert got == dict.fromkeys(("baseline", "lexical", "rg"), (3, 1.0, 1.0))


def test_retrieval_of_every_claim(spark, folder):
    assert {(r.query_id, r.relevant, r.found, r.recall) for r in asked(spark, folder, "evl_retrieval")} == {(q, 1, 1, 1.0) for q in ("1", "7", "150")}


def test_strategies_over_every_claim(spark, folder):
    got = {r.strategy: (r.queries, r.recall) for r in asked(spark, folder, "evl_strategies")}
    assert got == dict.fromkeys(("baseline", "lexical", "semantic", "hybrid", "rg"), (3, 1.0))


def test_every_claim_is_dispatched(spark, folder):
    """The first claim ends with a full stop, so it is an expression; the others are words."""
    assert {(r.query_id, r.id) for r in asked(spark, folder, "search_dispatched") if r.rank == 1} == {("1", "a:1"), ("7", "b:1"), ("150", "c:1")}


def test_every_claim_is_fused(spark, folder):
    got = {(r.query_id, r.id, r.sources) for r in asked(spark, folder, "search_fused") if r.rank == 1}
    assert got == {("1", "a:1", "lexical,semantic"), ("7", "b:1", "lexical,semantic"), ("150", "c:1", "lexical,semantic")}


def test_hybrid_search_of_every_claim(spark, folder):
    assert {(r.query_id, r.id) for r in asked(spark, folder, "search_hybrid") if r.rank == 1} == {("1", "a:1"), ("7", "b:1"), ("150", "c:1")}
