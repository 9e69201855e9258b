import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluate as E
from quillspark.operators import report as P
from quillspark.operators import search as R
from quillspark.sources import runs as U
from quillspark.streaming import ingest as G


def test_runs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "run_id string, t int, result string").withColumn("created_at", F.timestamp_seconds("t"))
    U.save_run(df, f"{tmp_path}/r", "find")
    U.save_run(spark.createDataFrame([({"k": 3},)], "config struct<k:int>"), f"{tmp_path}/r", "other")
    assert [r.run_id for r in U.list_runs(spark, f"{tmp_path}/r", 1, "find").collect()] == ["b"] and U.get_run(spark, f"{tmp_path}/r", "a").first().result == "x"
    made = U.list_runs(spark, f"{tmp_path}/r", 9, "other").first()
    assert made.config == '{"k":3}' and len(made.run_id) == 36
    run = U.log_status(spark, f"{tmp_path}/c", "queued", left="l", right="r")
    U.log_status(spark, f"{tmp_path}/c", "failed", run, error="e")
    last = U.comparison_runs(spark, f"{tmp_path}/c").first()
    assert (last.status, last.left_document_id, last.right_document_id, last.error) == ("failed", "l", "r", "e")


def test_cache(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert U.cache_get(spark, path, "k/1") is None
    U.cache_set(spark, path, "k/1", b"\x00a")
    U.cache_set(spark, path, "k/1", b"\x00b")
    assert U.cache_get(spark, path, "k/1") == b"\x00b"
    U.cache_delete(spark, path, "k/1")
    assert U.cache_get(spark, path, "k/1") is None


def test_settings():
    s = U.Settings.from_env({"QUILL_TOP_K": "5", "QUILL_STRATEGIES": "rg, lexical,", "QUILL_PDF_BYTES": "many", "QUILL_INDEX_NAME": " "})
    assert (s.top_k, s.strategies, s.pdf_bytes, s.index_name) == (5, ("rg", "lexical"), 50 << 20, "default")
    assert U.error_class(ValueError()) == "validation" and U.error_class(OSError()) == "storage" and U.error_class(KeyError()) == "unknown"


def test_packs(spark):
    df = spark.createDataFrame([(1, "q  a", ["x", ""]), (2, " ", ["y"]), (3, "long " * 9, ["z"]), (4, None, None)], "id int, q string, t array<string>")
    samples, corpus, skipped = E.load_pack(lambda: df, "q", "id", "t", 20)
    assert [r.query for r in samples.collect()] == ["q a"] and corpus.count() == 1 and skipped == 3

    def broken():
        raise OSError("gone")

    for read, code in ((lambda: df.where("false"), "empty_split"), (lambda: df.drop("q"), "schema_mismatch"), (broken, "dataset_access_error")):
        with pytest.raises(E.PackError) as e:
            E.load_pack(read, "q", "id", "t")
        assert e.value.code == code


def test_economics_of_nothing(spark):
    row = E.economics(spark.createDataFrame([], "prompt_tokens int")).first()
    assert row.runs == 0 and row.avg_compression_ratio == 1.0 and row.total_tokens == 0


def test_dispatch(spark):
    corpus = spark.createDataFrame([("a", "Budget of 50 pumps"), ("b", "budget (draft"), ("c", None), ("d", "numéro ²"), ("e", "")], "id string, text string")
    asked = spark.createDataFrame([("plain", "budget pumps"), ("re", r"bud\w+ of"), ("bad", "draft("), ("none", None), ("blank", " "), ("open", r"n.m")], "query_id string, query string")
    got = {}
    for how in ("lexical", "rg"):
        for r in R.run(spark, corpus, asked, how, 5).collect():
            got.setdefault((how, r.query_id), []).append((r.rank, r.id, r.candidate_count))
    for how in ("lexical", "rg"):
        assert [x[1] for x in sorted(got[how, "plain"])] == ["a", "b"] and got[how, "plain"][0][2] == 2
        assert [x[1] for x in got[how, "bad"]] == ["b"] and (how, "blank") not in got and [x[1] for x in got[how, "open"]] == ["d"]
    assert [x[1] for x in got["rg", "plain"]] == ["a", "b"]

    def failing(df, text):
        raise RuntimeError("no encoder")

    rows = R.run(spark, corpus, asked, "whatever", 5, encode=failing).collect()
    assert rows and all(r.semantic_error.startswith("RuntimeError") for r in rows)


def test_grounded_falls_back(spark):
    corpus = spark.createDataFrame([("a", "pump late", "d1"), ("b", "pump", "d2"), ("c", "valve", "d3")], "id string, text string, document_id string")
    asked = spark.createDataFrame([("q1", "pump", "d1"), ("q2", "pump", "d2"), ("q3", "pump", "d3"), ("q4", "pump", None)], "query_id string, query string, document_id string")
    rows = {r.query_id: (r.id, r.mode) for r in R.grounded(corpus, asked, 5, corpus.where("id = 'a'").select("id")).collect()}
    assert rows == {"q1": ("a", "index"), "q2": ("b", "reindexed")}


def test_late_and_repeated_runs(spark, tmp_path):
    layout = "array<array<struct<index:int,label:string,bbox_2d:struct<x1:double,y1:double,x2:double,y2:double>,content:string>>>"
    shape = f"id string, document_id string, created long, md_results string, layout_details {layout}, data_info struct<pages:array<struct<width:int,height:int>>>"
    source = f"{tmp_path}/ocr_responses.parquet"
    batches = [[("r2", "d", 20, "new text"), ("x1", "e", 5, "other")], [("r1", "d", 10, "old text")], [("r2", "d", 20, "new text")], [("x2", "e", 9, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, None, None) for r in rows], shape).coalesce(1).write.mode("append").parquet(source)
        G.units_stream(G.table_stream(spark, str(tmp_path), "ocr_responses", 1), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        units = {(r.document_id, r.content) for r in G.current_units(spark, f"{tmp_path}/out").collect()}
        assert ("d", "new text") in units and len(units) == (2 if k < 3 else 1)
    G.compacted(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    assert spark.read.parquet(f"{tmp_path}/small").count() == 1


def test_summaries(spark):
    none = spark.createDataFrame([("p",), ("q",)], "pair_id string")
    rows = [("p", 1, "T1", "s", "date_change", "high", "date", "1 mai", "2 mai", "1 mai", "2 mai", 2, 0), ("p", 2, "T2", "s2", "text_change", "medium", "block_text", "a", "b", "", "", 1, 1)]
    df = spark.createDataFrame(rows, "pair_id string, number int, title string, summary string, subtype string, importance string, field_type string, left_raw string, right_raw string, left_normalized string, right_normalized string, left_page int, right_page int").withColumn("ops", F.expr("array(named_struct('op', 'delete', 'text', 'a'), named_struct('op', 'insert', 'text', 'b'))"))
    got = {r.pair_id: r.summary for r in P.summaries(df, none).collect()}
    assert got["p"].split("\n")[0].startswith("- T1: La date passe de '1 mai' à '2 mai'") and "- T2: Le texte passe de 'a' à 'b'." in got["p"] and got["q"] == P.NO_CHANGE
    asked = spark.createDataFrame([("c", "g", ["p1", "p2", "p3"], [("e", "t")])], "claim string, category string, blocks array<string>, evidence array<struct<id:string,text:string>>")
    shown = asked.select(P.comparison_prompt("claim", "category", F.struct("claim"), "blocks").alias("a"), P.grounded_prompt("claim", "evidence").alias("b"), P.explanation_prompt(F.struct("claim")).alias("c"), P.summary_prompt(F.array("claim")).alias("d")).first()
    assert "p2" in shown.a and "p3" not in shown.a and "[e] t" in shown.b and '"claim":"c"' in shown.c and '["c"]' in shown.d
