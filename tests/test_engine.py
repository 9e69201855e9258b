from pyspark.sql import functions as F

from quillspark import boundary
from quillspark.engine import Engine
from quillspark.plans import text as PT
from quillspark.sources import files


def folder(spark, tmp_path):
    rows = [("e1", "d1", "Budget annuel 50 millions", 1, 1), ("e1", "d1", "Budget annuel 60 millions", 1, 2), ("e2", "d1", "Livraison le 2026-03-25", 2, 1), ("e3", "d2", None, None, 1)]
    df = spark.createDataFrame(rows, "evidence_id string, document_id string, content string, page_number int, t int").withColumn("ingested_at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    df.withColumn("source_type", F.lit("text")).write.parquet(f"{tmp_path}/evidence_units.parquet")
    return str(tmp_path)


def test_engine(spark, tmp_path):
    e = Engine(spark, folder(spark, tmp_path))
    assert e.units().count() == 3 and "hybrid" in e.info()["strategies"]
    assert [r.id for r in e.search("budget 60", "lexical", 1).collect()] == ["e1"]
    assert [r.id for r in e.search(r"Livraison.*\d{4}", "lexical").collect()] == ["e2"] == [r.id for r in e.search("/LIVRAISON/i", "rg").collect()]
    assert e.search("budget", "lexical", 5, ["d2"]).count() == 0
    assert {r.evidence_id for r in e.facts().where("size(facts) > 0").collect()} == {"e2"}
    e.register()
    assert spark.sql("SELECT quill_similarity('a b', 'A  B') AS s").first().s == 1.0


def test_scans_read_only_what_they_need(spark, tmp_path):
    df = PT.QUERIES["txt_normalize"](spark, folder(spark, tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<evidence_id:string,content:string>" in plan and "Exchange" not in plan


def test_index_table(spark, tmp_path):
    from quillspark.operators import search as R

    corpus = spark.createDataFrame([("a", "alpha beta"), ("b", "beta gamma")], "id string, text string")
    files.save_index(R.trigram_index(corpus), f"{tmp_path}/index", "one")
    index = files.load_index(spark, f"{tmp_path}/index", "one")
    assert [r.id for r in R.candidates(index, R.planner.plan("gamm.")).collect()] == ["b"]


def test_boundaries(spark):
    df = spark.createDataFrame([('{"verdict": "ok"}', True), ('so: {"verdict": "bad"} indeed', False), ("none", False), (None, None)], "a string, needs_judge boolean")
    assert [r[0] and r[0].verdict for r in df.select(boundary.parsed_answer("a", "verdict string")).collect()] == ["ok", "bad", None, None]
    assert boundary.LocalJudge().judge(df).where("judged_by = 'none'").count() == 1
