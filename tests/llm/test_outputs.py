"""The output queries have every field of their problem."""

from quillspark.llm import queries


def test_all_fields_come_out(spark, tmp_path):
    layout = "array<array<struct<index:int,label:string,content:string>>>"
    spark.createDataFrame([("u", "d", "Write to ann.smith@example.org now."), ("v", "d", None)], "evidence_id string, document_id string, content string").write.parquet(f"{tmp_path}/evidence_units.parquet")
    scans = [("s", "d", "Mail ann.smith@example.org please.", [[(0, "text", "Mail ann.smith@example.org please."), (1, "text", "aﬁx")]]), ("t", "d", None, [[(0, "text", "x y")]])]
    spark.createDataFrame(scans, f"id string, document_id string, md_results string, layout_details {layout}").write.parquet(f"{tmp_path}/ocr_responses.parquet")
    folder = str(tmp_path)
    redacted = {(r.src, r.row_key): r.redacted for r in queries.p2_redacted_evidence(spark, folder).collect()}
    assert redacted[("evidence", "u")] == "Write to [EMAIL] now." and redacted[("ocr", "s")] == "Mail [EMAIL] please." and set(redacted) == {("evidence", "u"), ("evidence", "v"), ("ocr", "s"), ("ocr", "t")}
    unified = {r.item_key: r.unified for r in queries.p5_unified_evidence(spark, folder).collect()}
    assert set(unified) == {"e:u", "e:v", "l:s:p1:e0", "l:s:p1:e1", "l:t:p1:e0"} and unified["l:s:p1:e0"] == "Mail ann.smith@example.org please."
    assert {r.item_key for r in queries.p4_repaired(spark, folder).collect()} == {"m:s", "l:s:p1:e0", "l:s:p1:e1", "l:t:p1:e0"}
