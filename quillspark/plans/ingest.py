"""Queries over ingest operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..sources import files
from ..sources.tables import table
from . import sql as S


def _ocr(spark, folder):
    return table(spark, folder, "ocr_responses")


def boxes(spark, folder):
    e = I.layout_elements(_ocr(spark, folder), "id")
    return e.where("box is not null").select("id", "page", "element", *[F.round(f"box.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


def ranges(spark, folder):
    pages = table(spark, folder, "parsed_pages").select("document_id", "total_pages").distinct()
    return I.page_ranges(pages, "document_id", "total_pages", 15).withColumn("most", F.lit(15)).unionByName(I.page_ranges(pages, "document_id", "total_pages", 12).withColumn("most", F.lit(12)))


def units(spark, folder):
    return I.evidence_units(I.latest_runs(_ocr(spark, folder)))


def map_text(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def uploads(spark, folder):
    p = table(spark, folder, "parsed_pages")
    return p.select("document_id", "page_number", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"), I.safe_filename("filename").alias("saved_filename"), I.mime_type("filename").alias("mime"))


def addresses(spark, folder):
    p = table(spark, folder, "parsed_pages").select("document_id", "filename", "page_number").distinct()
    uri = F.when(F.col("page_number") % 5 == 1, F.concat(F.lit("http://h/"), "filename")).when(F.col("page_number") % 5 == 2, F.concat(F.lit("s3:///"), "filename")).when(F.col("page_number") % 5 == 3, F.concat(F.lit("s3://"), "document_id")).otherwise(F.concat(F.lit("s3://"), "document_id", F.lit("/in/"), "filename"))
    return p.select("document_id", "page_number", I.uri_parts(uri).alias("u"), F.element_at(F.split(uri, "/"), -1).alias("last_segment")).select("document_id", "page_number", "u.*", "last_segment")


def deleted(spark, folder):
    gone = I.latest_status(table(spark, folder, "status_log")).where("status = 'error'")
    return I.without(_ocr(spark, folder).select("id", "document_id"), gone, "document_id")


def by_predicate(spark, folder):
    e = table(spark, folder, "evidence_units").select("evidence_id", "source_type", "page_number", "content")
    return e.where(~F.coalesce(F.expr("source_type = 'markdown_block' AND page_number <= 1"), F.lit(False))).select("evidence_id", "source_type", "page_number")


def listing(spark, folder):
    p = table(spark, folder, "parsed_pages")
    docs = p.groupBy("document_id").agg(F.max("total_pages").alias("total_pages"), F.countDistinct("page_number").alias("pages_seen"), F.max("parsed_at").alias("parsed_at"))
    status = I.latest_status(table(spark, folder, "status_log")).select("document_id", "status", "progress")
    done = _ocr(spark, folder).where("md_results is not null").select("document_id").distinct().withColumn("extracted", F.lit(True))
    j = docs.join(status, "document_id", "left").join(done, "document_id", "left")
    shown = F.when(F.col("extracted"), F.lit("completed")).when(F.col("status").isNotNull(), F.col("status")).otherwise(F.lit("processing"))
    return j.select("document_id", "total_pages", "pages_seen", shown.alias("shown_status"), F.when(F.col("extracted"), F.lit(1.0)).otherwise(F.coalesce("progress", F.lit(0.5))).alias("shown_progress"))


def contents(spark, folder):
    runs = I.latest_runs(_ocr(spark, folder)).where("md_results is not null and layout_details is not null")
    meta = table(spark, folder, "parsed_pages").groupBy("document_id").agg(F.max("total_pages").alias("pages"))
    return runs.join(meta, "document_id", "left").select("document_id", F.char_length("md_results").alias("chars"), F.size("layout_details").alias("layout_pages"), "pages")


def shapes(spark, folder):
    """Search results as a server may return them, in four shapes of JSON, read back to rows."""
    e = table(spark, folder, "evidence_units").where("content is not null").select("evidence_id", "document_id", F.char_length("content").alias("n")).distinct()
    form = F.pmod(F.col("n"), F.lit(3))
    js = F.when(form == 0, F.to_json(F.struct(F.array(F.struct(F.col("evidence_id").alias("id"), F.col("n").alias("score"))).alias("results")))).when(form == 1, F.to_json(F.struct(F.array(F.struct(F.col("evidence_id").alias("id"), F.col("n").alias("score"))).alias("data")))).otherwise(F.to_json(F.struct(F.array("evidence_id").alias("document_ids"), F.array("n").alias("scores"))))
    item = "array<struct<id:string,score:double>>"
    parsed = e.select("evidence_id", F.from_json(js, f"results {item}, data {item}, document_ids array<string>, scores array<double>").alias("r"))
    rows = F.coalesce("r.results", "r.data", F.transform(F.arrays_zip("r.document_ids", "r.scores"), lambda z: F.struct(z["document_ids"].alias("id"), z["scores"].alias("score"))))
    return parsed.select(F.explode(rows).alias("x")).select("x.id", "x.score")


QUERIES = {
    "ing_page_ranges": ranges,
    "ing_boxes": boxes,
    "ing_layout_labels": lambda s, f: I.layout_elements(_ocr(s, f), "id").groupBy("label").agg(F.count("*").alias("elements"), F.count("box").alias("boxes")),
    "ing_evidence_units": units,
    "ing_span_units": lambda s, f: I.span_units(table(s, f, "context_bundles").where("snippets is not null").select("document_id", F.transform("snippets", lambda x: F.coalesce(T.sentences(x), F.array().cast("array<string>"))).alias("spans")), "document_id", F.col("spans")),
    "ing_clean_metadata": lambda s, f: table(s, f, "evidence_units").where("metadata is not null").select("evidence_id", map_text(I.clean_map("metadata")).alias("metadata")),
    "ing_merged_runs": lambda s, f: I.merged_runs(_ocr(s, f)).select("document_id", F.md5("md").alias("md"), F.char_length("md").alias("chars"), "n_pages", "total_tokens"),
    "snk_uploads": uploads,
    "snk_extractions": lambda s, f: _ocr(s, f).select("id", F.coalesce(F.size("layout_details"), F.lit(0)).alias("num_pages"), F.coalesce(F.aggregate(F.transform("layout_details", lambda p: F.greatest(F.coalesce(F.size(p), F.lit(0)), F.lit(0))), F.lit(0), lambda a, b: a + b), F.lit(0)).alias("num_elements")),
    "snk_latest_status": lambda s, f: I.latest_status(table(s, f, "status_log")),
    "snk_upserted_units": lambda s, f: I.upserted(table(s, f, "evidence_units")).select("evidence_id", "content", "ingested_at"),
    "snk_delete_cascade": deleted,
    "snk_delete_predicate": by_predicate,
    "src_addresses": addresses,
    "src_data_urls": lambda s, f: table(s, f, "parsed_pages").select("document_id", "page_number", files.limited_url(F.col("text"), I.mime_type("filename")).alias("url")),
    "src_documents": listing,
    "src_contents": contents,
    "src_latest_runs": lambda s, f: _ocr(s, f).select("id", "document_id", "created").distinct().orderBy(F.desc("created"), F.desc("id")).limit(25),
    "src_result_shapes": shapes,
}

_ELEMENTS = "(SELECT id, document_id, page, e - 1 AS element, els[e] AS x, sz FROM (SELECT *, unnest(generate_series(1, len(els))) AS e FROM (SELECT id, document_id, p AS page, layout_details[p] AS els, data_info.pages[p] AS sz FROM (SELECT *, unnest(generate_series(1, len(layout_details))) AS p FROM {src}))) WHERE els[e].label IN ('text', 'image', 'formula', 'table'))"
_LATEST = "(SELECT * FROM ocr_responses QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created DESC, id DESC) = 1)"
_B = "x.bbox_2d"
_SMALL = f"greatest(abs({_B}.x1), abs({_B}.y1), abs({_B}.x2), abs({_B}.y2)) <= 1"
_SIZED = "coalesce(sz.width > 0 AND sz.height > 0, false)"


def _box(k: str) -> str:
    of = f"CASE WHEN {_SMALL} THEN 1.0::DOUBLE WHEN {_SIZED} THEN sz.{'width' if k[0] == 'x' else 'height'}::DOUBLE ELSE greatest({_B}.{k[0]}1, {_B}.{k[0]}2, 1.0) END"
    return f"round(least(greatest({_B}.{k} / ({of}), 0.0), 1.0), 6) AS {k}"


_TRIMMED = f"(SELECT * FROM (SELECT document_id, page, element, x.label AS label, {S.trimmed('x.content')} AS content FROM {_ELEMENTS.format(src=_LATEST)}) WHERE content <> '')"
_STATUS = "(SELECT document_id, lower(status) AS status, greatest(0.0, least(1.0, progress)) AS progress, pages_processed, total_pages, error FROM status_log QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY try_cast(regexp_replace(replace(updated_at, 'T', ' '), '(Z|\\+00:?00)$', '') AS TIMESTAMP) DESC NULLS LAST, arrived_at DESC NULLS LAST, lower(status) DESC NULLS LAST, greatest(0.0, least(1.0, progress)) DESC NULLS LAST, pages_processed DESC NULLS LAST, total_pages DESC NULLS LAST, error DESC NULLS LAST) = 1)"
_SAFE = "regexp_replace(filename, '[^\\p{L}\\p{N}_.-]', '_', 'g')"
_MIME = "CASE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.MIME.items()) + " ELSE 'application/octet-stream' END"
_URI = "CASE WHEN page_number % 5 = 1 THEN 'http://h/' || filename WHEN page_number % 5 = 2 THEN 's3:///' || filename WHEN page_number % 5 = 3 THEN 's3://' || document_id ELSE 's3://' || document_id || '/in/' || filename END"
ORACLE = {
    "ing_page_ranges": " UNION ALL ".join(f"SELECT document_id, f AS first_page, least(f + {m} - 1, total_pages) AS last_page, {m} AS most FROM (SELECT *, unnest(generate_series(1, total_pages, {m})) AS f FROM (SELECT DISTINCT document_id, total_pages FROM parsed_pages WHERE total_pages >= 1))" for m in (15, 12)),
    "ing_boxes": f"SELECT id, page, element, {', '.join(_box(k) for k in ('x1', 'y1', 'x2', 'y2'))} FROM {_ELEMENTS.format(src='ocr_responses')} WHERE {_B} IS NOT NULL AND {_B}.x1 IS NOT NULL AND {_B}.y1 IS NOT NULL AND {_B}.x2 IS NOT NULL AND {_B}.y2 IS NOT NULL",
    "ing_layout_labels": f"SELECT x.label AS label, count(*) AS elements, count({_B}) AS boxes FROM {_ELEMENTS.format(src='ocr_responses')} GROUP BY 1",
    "ing_evidence_units": f"""
WITH els AS {_TRIMMED}, runs AS {_LATEST},
blocks AS (SELECT document_id, i - 1 AS block, parts[i] AS content FROM (SELECT document_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT document_id, {S.kept(f"string_split_regex(md_results, '\\n[{S.WS}]*\\n')")} AS parts FROM runs WHERE document_id IN (SELECT document_id FROM els))))
SELECT document_id || ':p' || page || ':e' || element AS evidence_id, document_id, content, label AS source_type, page AS page_number FROM els
UNION ALL SELECT document_id || ':markdown:' || block, document_id, content, 'markdown_block', 1 FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM els WHERE els.document_id = b.document_id AND {S.normalized('els.content')} = {S.normalized('b.content')}) AND NOT (starts_with(content, '#') AND NOT contains(content, chr(10)))
UNION ALL SELECT document_id || ':markdown:0', document_id, {S.trimmed('md_results')}, 'markdown', 1 FROM runs WHERE document_id NOT IN (SELECT document_id FROM els) AND {S.trimmed('md_results')} <> ''
""",
    "ing_span_units": f"SELECT document_id || ':' || (e - 1) || ':' || (s - 1) AS evidence_id, document_id, spans[s] AS content FROM (SELECT document_id, e, spans, unnest(generate_series(1, len(spans))) AS s FROM (SELECT document_id, e, {S.chunks('snippets[e]', '.!?;:')} AS spans FROM (SELECT document_id, snippets, unnest(generate_series(1, len(snippets))) AS e FROM context_bundles)))",
    "ing_clean_metadata": f"SELECT evidence_id, array_to_string(list_sort(list_transform(list_filter(good, lambda e, i: list_position(list_reverse(list_transform(good, lambda o: o.k)), e.k) = len(good) - i + 1), lambda e: e.k || '=' || e.v)), '|') AS metadata FROM (SELECT evidence_id, list_filter(list_transform(map_entries(metadata), lambda e: struct_pack(k := replace(lower({S.trimmed('e.key')}), ' ', '_'), v := {S.trimmed('e.value')})), lambda e: e.v IS NOT NULL AND e.v <> '' AND e.k <> '') AS good FROM evidence_units WHERE metadata IS NOT NULL)",
    "ing_merged_runs": "SELECT document_id, md5(coalesce(md, '')) AS md, length(coalesce(md, '')) AS chars, n_pages, total_tokens FROM (SELECT document_id, string_agg(CASE WHEN md_results <> '' THEN md_results END, chr(10) || chr(10) ORDER BY created, id) AS md, sum(pages) AS n_pages, sum(tokens) AS total_tokens FROM (SELECT DISTINCT id, document_id, created, md_results, coalesce(len(layout_details), 0) AS pages, token_usage.total_tokens AS tokens FROM ocr_responses) GROUP BY document_id)",
    "snk_uploads": f"SELECT document_id, page_number, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, coalesce(nullif({_SAFE}, ''), 'unnamed') AS saved_filename, {_MIME} AS mime FROM parsed_pages",
    "snk_extractions": "SELECT id, coalesce(len(layout_details), 0) AS num_pages, coalesce(list_sum(list_transform(layout_details, lambda p: coalesce(len(p), 0))), 0) AS num_elements FROM ocr_responses",
    "snk_latest_status": f"SELECT * FROM {_STATUS}",
    "snk_upserted_units": "SELECT evidence_id, content, ingested_at FROM evidence_units QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at DESC NULLS LAST, content DESC NULLS LAST) = 1",
    "snk_delete_cascade": f"SELECT id, document_id FROM ocr_responses WHERE document_id NOT IN (SELECT document_id FROM {_STATUS} WHERE status = 'error')",
    "snk_delete_predicate": "SELECT evidence_id, source_type, page_number FROM evidence_units WHERE NOT coalesce(source_type = 'markdown_block' AND page_number <= 1, false)",
    "src_addresses": f"SELECT document_id, page_number, CASE WHEN problem IS NULL THEN b END AS bucket, CASE WHEN problem IS NULL THEN k END AS key, problem, last_segment FROM (SELECT *, CASE WHEN NOT starts_with(uri, 's3://') THEN 'scheme' WHEN b = '' THEN 'bucket' WHEN k = '' THEN 'key' END AS problem, list_last(string_split(uri, '/')) AS last_segment FROM (SELECT *, regexp_extract(uri, '^s3://([^/]*)', 1) AS b, regexp_extract(uri, '^s3://[^/]*/(.*)$', 1) AS k FROM (SELECT DISTINCT document_id, page_number, filename, {_URI} AS uri FROM parsed_pages)))",
    "src_data_urls": f"SELECT document_id, page_number, CASE WHEN octet_length(encode(text)) <= CASE WHEN starts_with({_MIME}, 'image/') THEN 10485760 ELSE 52428800 END THEN 'data:' || {_MIME} || ';base64,' || to_base64(encode(text)) END AS url FROM parsed_pages",
    "src_documents": f"SELECT d.document_id, d.total_pages, d.pages_seen, CASE WHEN x.document_id IS NOT NULL THEN 'completed' WHEN s.status IS NOT NULL THEN s.status ELSE 'processing' END AS shown_status, CASE WHEN x.document_id IS NOT NULL THEN 1.0 ELSE coalesce(s.progress, 0.5) END AS shown_progress FROM (SELECT document_id, max(total_pages) AS total_pages, count(DISTINCT page_number) AS pages_seen FROM parsed_pages GROUP BY 1) d LEFT JOIN {_STATUS} s USING (document_id) LEFT JOIN (SELECT DISTINCT document_id FROM ocr_responses WHERE md_results IS NOT NULL) x ON x.document_id = d.document_id",
    "src_contents": f"SELECT r.document_id, length(md_results) AS chars, len(layout_details) AS layout_pages, pages FROM {_LATEST} r LEFT JOIN (SELECT document_id, max(total_pages) AS pages FROM parsed_pages GROUP BY 1) m USING (document_id) WHERE md_results IS NOT NULL AND layout_details IS NOT NULL",
    "src_latest_runs": "SELECT DISTINCT id, document_id, created FROM ocr_responses ORDER BY created DESC, id DESC LIMIT 25",
    "src_result_shapes": "SELECT DISTINCT evidence_id AS id, length(content)::DOUBLE AS score FROM evidence_units WHERE content IS NOT NULL",
}
