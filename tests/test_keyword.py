import random

import __spark_entry__
import pytest
from quillspark.operators import keyword as K
from quillspark.operators import search as R

WORDS = ["cap", "caps", "the cap", "İl", "ﬁn", "漢字", "a", "9", "42", "ré", "😀", "-", " ", "clause 4.2", "NOTE", "recap"]


def _tables(spark, many):
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    texts = [(f"d{k % 7}:{k}", text(9)) for k in range(many)] + [("n", None), (None, "the cap 42"), ("s1", "a"), ("s2", "9 "), ("s3", "😀")]
    asked = [(f"q{k}", text(6)) for k in range(40)] + [("s", "a"), ("t", "😀"), ("long", "the cap 9 " * 300), ("marks", "- -"), ("none", None), ("blank", " ")]
    return spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(asked, "query_id string, query string")


@pytest.fixture
def small_batches(spark):
    """Many batches in a task, so that the best of each are merged."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("how", ["baseline", "lexical", "rg"])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_one_pass_finds_what_the_join_finds(spark, small_batches, how, k):
    corpus, queries = _tables(spark, 400)
    joined = (R.contained if how == "rg" else R.counted)(corpus.where("id is not null"), queries)
    want = R.best(R.scored(joined, how), k).select("query_id", "id", "rank", "score", "token_hits", "tokens").collect()
    got = R.keyword(corpus.where("id is not null"), queries, k, how).select("query_id", "id", "rank", "score", "token_hits", "tokens").collect()
    assert sorted(got) == sorted(want) and got


def test_blocks_of_queries_are_all_asked(spark, monkeypatch):
    monkeypatch.setattr(R, "ASKED", 7)
    corpus, queries = _tables(spark, 60)
    got = R.keyword(corpus, queries, 3).select("query_id", "id", "score").collect()
    want = R.best(R.scored(R.counted(corpus.where("id is not null"), queries), "lexical"), 3)
    assert {r.query_id for r in got} >= {r.query_id for r in want.collect()}


def test_many_signs_need_no_table():
    signs = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 600))
    m = K.Matrix([signs[:300], signs[300:]])
    assert m.vocabulary.table is None
    cells = m.of(K.pa.array([signs, signs[5:9], "xyz"]))
    assert K.held(cells, m.tri[0]).tolist() == [298, 2, 0] and K.held(cells, m.tri[1]).tolist() == [298, 0, 0]


def _pairs(*_):
    raise AssertionError("pairs of queries and texts are shuffled")


#: Queries that ranked from a shuffled table of all pairs, or from an index made for them.
RANKED = ["search_lexical_topk", "search_baseline_topk", "search_rg_topk", "search_overfetched", "search_filtered", "evl_hits", "search_dispatched", "search_fused", "search_hybrid", "evl_keyword_strategies", "evl_retrieval", "evl_strategies", "evl_best_strategy"]


@pytest.mark.parametrize("name", RANKED)
def test_no_table_of_pairs(spark, monkeypatch, name):
    for what in ("counted", "contained", "trigram_index"):
        monkeypatch.setattr(R, what, _pairs)
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()
