"""From OCR layouts to evidence units, and the tables kept about documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = ("text", "image", "formula", "table")
# Types of files by their ending.
MIME = {"pdf": "application/pdf", "json": "application/json", "md": "text/markdown", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def page_ranges(df: DataFrame, key: str, pages: str, most: int) -> DataFrame:
    """(key, first_page, last_page): the pages 1..n in ranges of at most ``most``; none for n below 1 or null."""
    some = df.where(F.col(pages) >= 1)
    first = some.select(key, pages, F.explode(F.sequence(F.lit(1), F.col(pages), F.lit(most))).alias("first_page"))
    return first.select(key, "first_page", F.least(F.col("first_page") + most - 1, F.col(pages)).alias("last_page"))


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of its page: as it is if within one, else by the page's size, else by its own reach."""
    c = {k: box[k] for k in ("x1", "y1", "x2", "y2")}
    small = F.greatest(*[F.abs(v) for v in c.values()]) <= 1
    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))
    across = F.when(small, F.lit(1.0)).when(sized, width.cast("double")).otherwise(F.greatest(c["x1"], c["x2"], F.lit(1.0)))
    down = F.when(small, F.lit(1.0)).when(sized, height.cast("double")).otherwise(F.greatest(c["y1"], c["y2"], F.lit(1.0)))
    share = lambda v, of: F.least(F.greatest(v / of, F.lit(0.0)), F.lit(1.0))
    made = F.struct(*[share(c[k], across if k[0] == "x" else down).alias(k) for k in c])
    whole = c["x1"].isNotNull() & c["y1"].isNotNull() & c["x2"].isNotNull() & c["y2"].isNotNull()
    return F.when(box.isNotNull() & whole, made)


def layout_elements(ocr: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, element, index, label, content, box, width, height): elements of a known label, page from 1, element from 0."""
    pages = ocr.select(*keys, "data_info", F.posexplode("layout_details").alias("p", "elements"))
    rows = pages.select(*keys, (F.col("p") + 1).alias("page"), F.get(F.col("data_info.pages"), F.col("p")).alias("size"), F.posexplode("elements").alias("element", "e"))
    rows = rows.where(F.col("e.label").isin(*LABELS))
    return rows.select(*keys, "page", "element", F.col("e.index").alias("index"), F.col("e.label").alias("label"), F.col("e.content").alias("content"), unit_box(F.col("e.bbox_2d"), F.col("size.width"), F.col("size.height")).alias("box"), F.col("size.width").alias("width"), F.col("size.height").alias("height"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; one shuffle on the key, so equal keys of any number are sorted, not collected."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def latest_runs(ocr: DataFrame) -> DataFrame:
    """The last run of each document, by creation and then id; repeated rows count once."""
    return latest(ocr, ["document_id"], F.desc("created"), F.desc("id"))


def evidence_units(runs: DataFrame) -> DataFrame:
    """(evidence_id, document_id, content, source_type, page_number) of one run per document.

    Layout elements with content; beside them the blocks of the running text that no element
    holds and that are no lone headings; the whole text where no element has content.
    """
    elements = layout_elements(runs, "document_id").withColumn("content", T.trimmed("content")).where("content <> ''")
    laid = elements.select(F.concat_ws(":", "document_id", F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("e"), F.col("element").cast("string"))).alias("evidence_id"), "document_id", "content", F.col("label").alias("source_type"), F.col("page").alias("page_number"))
    held = elements.select("document_id", T.normalized("content").alias("norm")).distinct()
    with_layout = elements.select("document_id").distinct()
    text = runs.select("document_id", "md_results")
    blocks = text.join(with_layout, "document_id", "left_semi").select("document_id", F.posexplode(F.filter(F.transform(F.split("md_results", rf"\n[{T.WS}]*\n"), T.trimmed), lambda b: b != "")).alias("block", "content"))
    fresh = blocks.withColumn("norm", T.normalized("content")).join(held, ["document_id", "norm"], "left_anti")
    fresh = fresh.where(~(F.startswith("content", F.lit("#")) & ~F.contains("content", F.lit("\n"))))
    marked = fresh.select(F.concat_ws(":", "document_id", F.lit("markdown"), F.col("block").cast("string")).alias("evidence_id"), "document_id", "content", F.lit("markdown_block").alias("source_type"), F.lit(1).alias("page_number"))
    alone = text.join(with_layout, "document_id", "left_anti").withColumn("content", T.trimmed("md_results")).where("content <> ''")
    whole = alone.select(F.concat_ws(":", "document_id", F.lit("markdown"), F.lit("0")).alias("evidence_id"), "document_id", "content", F.lit("markdown").alias("source_type"), F.lit(1).alias("page_number"))
    return laid.unionByName(marked).unionByName(whole)


def span_units(df: DataFrame, document: str, spans: Column) -> DataFrame:
    """(evidence_id, document_id, content) from an array of arrays of spans; empty spans are left out, numbers count from 0."""
    groups = df.select(F.col(document).alias("document_id"), F.posexplode(spans).alias("e", "inner"))
    rows = groups.select("document_id", "e", F.posexplode("inner").alias("s", "content")).where("content is not null and content <> ''")
    return rows.select(F.concat_ws(":", "document_id", F.col("e").cast("string"), F.col("s").cast("string")).alias("evidence_id"), "document_id", "content")


def clean_map(m: str | Column) -> Column:
    """A map with keys trimmed, in lower case, blanks made underscores, values trimmed, null and blank ones dropped; of keys that become equal the last stays."""
    m = T.col(m)
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.regexp_replace(F.lower(T.trimmed(e["key"])), " ", "_").alias("key"), T.trimmed(e["value"]).alias("value")))
    good = F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "") & (e["key"] != ""))
    numbered = F.transform(good, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("at")))
    last = F.filter(numbered, lambda e: ~F.exists(numbered, lambda o: (o["key"] == e["key"]) & (o["at"] > e["at"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def merged_runs(ocr: DataFrame) -> DataFrame:
    """(document_id, md, n_pages, total_tokens): the runs of a document joined in order, as chunks of one text."""
    runs = ocr.select("id", "document_id", "created", "md_results", F.size("layout_details").alias("pages"), F.col("token_usage.total_tokens").alias("tokens")).distinct()
    parts = F.collect_list(F.struct("created", "id", F.col("md_results").alias("md")))
    md = F.array_join(F.transform(F.filter(F.array_sort(parts), lambda p: p["md"].isNotNull() & (p["md"] != "")), lambda p: p["md"]), "\n\n")
    return runs.groupBy("document_id").agg(md.alias("md"), F.sum(F.greatest(F.coalesce("pages", F.lit(0)), F.lit(0))).alias("n_pages"), F.sum("tokens").alias("total_tokens"))


def status_time(c: str | Column) -> Column:
    """ISO text in either form, with T or a blank, with or without a zone, as a timestamp of UTC without zone."""
    plain = F.regexp_replace(F.regexp_replace(T.col(c), "T", " "), r"(Z|\+00:?00)$", "")
    return F.try_to_timestamp(plain).cast("timestamp_ntz")


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each document: (document_id, status, progress, pages_processed, total_pages, error).

    Later updates win, of equal times the later arrival, then status and progress in order.
    Progress is held within [0, 1], status is in lower case.
    """
    rows = log.withColumn("_at", status_time("updated_at")).withColumn("status", F.lower("status")).withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress"))))
    order = (F.desc_nulls_last("_at"), F.desc_nulls_last("arrived_at"), F.desc_nulls_last("status"), F.desc_nulls_last("progress"), F.desc_nulls_last("pages_processed"), F.desc_nulls_last("total_pages"), F.desc_nulls_last("error"))
    return latest(rows, ["document_id"], *order).select("document_id", "status", "progress", "pages_processed", "total_pages", "error")


def upserted(units: DataFrame) -> DataFrame:
    """One row per evidence_id, the last delivered; of equal times the larger content."""
    return latest(units, ["evidence_id"], F.desc_nulls_last("ingested_at"), F.desc_nulls_last("content"))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose key is in ``gone``: a deletion that cascades to a table."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def safe_filename(c: str | Column) -> Column:
    """Characters other than letters, digits, _ - . made underscores; "unnamed" for empty or null."""
    safe = F.regexp_replace(T.col(c), r"[^\p{L}\p{N}_.-]", "_")
    return F.coalesce(F.when(safe != "", safe), F.lit("unnamed"))


def mime_type(c: str | Column) -> Column:
    """The type of a file by its ending; application/octet-stream where it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.get(F.array(table[F.lower(F.regexp_extract(T.col(c), r"\.([^.]*)$", 1))]), F.lit(0)), F.lit("application/octet-stream"))


def uri_parts(c: str | Column) -> Column:
    """(bucket, key, problem) of an object address; problem says what is wrong with it."""
    c = T.col(c)
    bucket, key = F.regexp_extract(c, "^s3://([^/]*)", 1), F.regexp_extract(c, "^s3://[^/]*/(.*)$", 1)
    problem = F.when(~F.startswith(c, F.lit("s3://")), F.lit("scheme")).when(bucket == "", F.lit("bucket")).when(key == "", F.lit("key"))
    return F.struct(F.when(problem.isNull(), bucket).alias("bucket"), F.when(problem.isNull(), key).alias("key"), problem.alias("problem"))


def data_url(content: Column, mime: Column, most: int | Column) -> Column:
    """The content as a data address, null where it is larger than ``most`` bytes."""
    return F.when(F.octet_length(content) <= most, F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content.cast("binary")), "[\r\n]", "")))
