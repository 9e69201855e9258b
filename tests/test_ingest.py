from pyspark.sql import functions as F

from quillspark.operators import ingest as I
from quillspark.sources import files

LAYOUT = "array<array<struct<index:int,label:string,bbox_2d:struct<x1:double,y1:double,x2:double,y2:double>,content:string>>>"
OCR = f"id string, document_id string, created long, md_results string, layout_details {LAYOUT}, data_info struct<pages:array<struct<width:int,height:int>>>"


def ocr(spark, *rows):
    return spark.createDataFrame([(f"r{i}", f"doc-{i}", i, md, layout, ([(1000, 2000)] * 3,)) for i, (md, layout) in enumerate(rows)], OCR)


def el(content, label="text", box=None, index=0):
    return (index, label, box, content)


def test_page_ranges(spark):
    df = spark.createDataFrame([("a", 32), ("b", 1), ("c", 0), ("d", None)], "k string, n int")
    assert sorted(map(tuple, I.page_ranges(df, "k", "n", 15).collect())) == [("a", 1, 15), ("a", 16, 30), ("a", 31, 32), ("b", 1, 1)]


def test_boxes(spark):
    df = ocr(spark, ("", [[el("a", box=(100.0, 200.0, 300.0, 400.0)), el("b", box=(0.1, 0.1, 0.5, 2.0)), el("c", label="seal", box=None), el("d", box=None)]]))
    rows = {r.content: r.box for r in I.layout_elements(df, "id").collect()}
    assert tuple(rows["a"]) == (0.1, 0.1, 0.3, 0.2) and rows["d"] is None and "c" not in rows


def test_units_of_layout_and_text(spark):
    df = ocr(
        spark,
        ("# md", [[el("Alpha")], [el(" Beta ")]]),
        ("only text", []),
        ("Alpha\n\nBeta paragraph\n\nGamma paragraph", [[el("Alpha"), el(None), el("  ")]]),
        (None, None),
    )
    rows = {r.evidence_id: (r.content, r.source_type, r.page_number) for r in I.evidence_units(df).collect()}
    assert rows == {
        "doc-0:p1:e0": ("Alpha", "text", 1), "doc-0:p2:e0": ("Beta", "text", 2), "doc-1:markdown:0": ("only text", "markdown", 1),
        "doc-2:p1:e0": ("Alpha", "text", 1), "doc-2:markdown:1": ("Beta paragraph", "markdown_block", 1), "doc-2:markdown:2": ("Gamma paragraph", "markdown_block", 1),
    }


def test_clean_map(spark):
    df = spark.createDataFrame([({" Author Name ": " X ", "b": "", "c": None},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(I.clean_map("m")).collect()] == [{"author_name": "X"}, None]
    twice = spark.sql("SELECT map(' A b', 'x', 'a_b', 'y') AS m")
    assert twice.select(I.clean_map("m")).first()[0] == {"a_b": "y"}


def test_latest_status(spark):
    rows = [("d", "OCR", 0.4, "2026-01-01T10:00:00", 1), ("d", "completed", 1.7, "2026-01-01 11:00:00+00:00", 2), ("d", "ocr", 0.4, "2026-01-01T09:00:00Z", 3), ("e", None, None, None, 4)]
    log = spark.createDataFrame(rows, "document_id string, status string, progress double, updated_at string, a int")
    log = log.withColumn("arrived_at", F.timestamp_seconds("a").cast("timestamp_ntz")).withColumns({"pages_processed": F.lit(1), "total_pages": F.lit(2), "error": F.lit(None).cast("string")})
    got = {r.document_id: (r.status, r.progress) for r in I.latest_status(log).collect()}
    assert got["d"] == ("completed", 1.0) and got["e"][0] is None


def test_small_columns(spark):
    df = spark.createDataFrame([("a b/ç.PDF", "s3://bucket/k/x"), ("", "s3:///x"), (None, "http://x"), ("x.md", "s3://b")], "f string, u string")
    r = df.select(I.safe_filename("f").alias("f"), I.mime_type("f").alias("m"), I.uri_parts("u").alias("u")).collect()
    assert [x.f for x in r] == ["a_b_ç.PDF", "unnamed", "unnamed", "x.md"]
    assert [x.m for x in r] == ["application/pdf", "application/octet-stream", "application/octet-stream", "text/markdown"]
    assert [tuple(x.u) for x in r] == [("bucket", "k/x", None), (None, None, "bucket"), (None, None, "scheme"), (None, None, "key")]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_rows(df, f"{tmp_path}/rows")
    assert sorted(map(tuple, files.read_rows(spark, f"{tmp_path}/rows", "k int, v string").collect())) == [(1, "a"), (2, None)]
    kept = files.delete_where(df, "v = :x", x="a")
    assert [r.k for r in kept.collect()] == [2]


def test_stream_over_files(spark, tmp_path):
    from quillspark.streaming import ingest as G

    df = ocr(spark, ("only text", []), ("b", [[el("Alpha")]])).withColumns({"filename": F.lit("f")})
    df.repartition(2).write.parquet(f"{tmp_path}/ocr_responses.parquet")
    assert {r.document_id for r in G.arrived_units(spark, str(tmp_path)).collect()} == {"doc-0", "doc-1"}
