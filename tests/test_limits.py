"""Limits of sizes are those of the reference."""

from pyspark.sql import functions as F

from quillspark.plans import ingest, review
from quillspark.sources import files


def test_data_urls_up_to_the_limit_of_their_kind(spark, tmp_path):
    rows = [("d", 1, "x.pdf", "y" * 1501), ("d", 2, "x.png", "z" * 20_000), ("d", 3, "x.pdf", None)]
    spark.createDataFrame(rows, "document_id string, page_number int, filename string, text string").write.parquet(f"{tmp_path}/parsed_pages.parquet")
    got = {r.page_number: r.url for r in ingest.QUERIES["src_data_urls"](spark, str(tmp_path)).collect()}
    assert len(got[1]) > 2000 and len(got[2]) > 26_000 and got[3] is None
    over = spark.range(1).select(*[files.limited_url(F.repeat(F.lit("a"), n), F.lit(m)).isNull().alias(f"c{k}") for k, (n, m) in enumerate([((10 << 20) + 1, "image/png"), (10 << 20, "image/png"), ((10 << 20) + 1, "application/pdf")])])
    assert tuple(over.first()) == (True, False, False)


def test_long_questions_are_in_the_pack(spark, tmp_path):
    rows = [(1, "d", "q" * 161, ["a"], 500), (2, "d", "r" * 8192, ["b"], 500), (3, "d", "s" * 8193, ["c"], 500)]
    spark.createDataFrame(rows, "bundle_id long, document_id string, claim string, snippets array<string>, max_chars int").write.parquet(f"{tmp_path}/context_bundles.parquet")
    assert {r.sample_id for r in review.QUERIES["evl_question_samples"](spark, str(tmp_path)).collect()} == {"1", "2"}
    assert {r.text for r in review.QUERIES["evl_question_corpus"](spark, str(tmp_path)).collect()} == {"a", "b"}
