"""The queries over the training-data operators, by the names the driver expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.units import padded
from ..session import materialize
from ..sources.tables import table
from . import encode, neardup, pack, pii, reading, scans, split, unify


def layout_items(spark: SparkSession, folder: str) -> DataFrame:
    """(id, document_id, page, element, label, content) of all layout elements, pages from 1."""
    ocr = table(spark, folder, "ocr_responses").select("id", "document_id", F.posexplode("layout_details").alias("p", "elements"))
    one = ocr.select("id", "document_id", (F.col("p") + 1).alias("page"), F.explode("elements").alias("e"))
    return one.select("id", "document_id", "page", F.col("e.index").alias("element"), F.col("e.label").alias("label"), F.col("e.content").alias("content"))


def layout_key(prefix: str = "l:"):
    return F.concat(F.lit(prefix), "id", F.lit(":p"), F.col("page").cast("string"), F.lit(":e"), F.col("element").cast("string"))


def p1_items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_kind, item_key, content, max_chars, overlap_chars) of the items over the limit of their kind."""
    units = table(spark, folder, "evidence_units").select(F.lit("evidence").alias("item_kind"), F.col("evidence_id").alias("item_key"), "content")
    pages = table(spark, folder, "parsed_pages").select(F.lit("page").alias("item_kind"), F.concat("document_id", F.lit(":p"), F.col("page_number").cast("string")).alias("item_key"), F.col("text").alias("content"))
    snippets = table(spark, folder, "context_bundles").select("bundle_id", F.posexplode("snippets").alias("position", "content"))
    snippets = snippets.select(F.lit("snippet").alias("item_kind"), F.concat(F.lit("b"), padded(F.col("bundle_id"), 10), F.lit(":"), F.col("position").cast("string")).alias("item_key"), "content")
    limits = table(spark, folder, "split_limits").select("item_kind", "max_chars", "overlap_chars")
    sized = units.unionByName(pages).unionByName(snippets).join(limits, "item_kind")
    return sized.where(F.char_length("content") > F.col("max_chars"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every item over the limit of its kind."""
    pieces = split.with_pieces(p1_items(spark, folder), "content", "max_chars", "overlap_chars")
    return pieces.select("item_kind", "item_key", "piece_no", "new_pos", "start_pos", "end_pos", "piece").distinct()


def p1_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every item over the limit put together again from its pieces: the digest of the text, and whether each piece fits and begins where the last one ended, less the overlap."""
    items = p1_items(spark, folder).withColumn("digest", F.md5("content"))
    pieces = split.with_pieces(items, "content", "max_chars", "overlap_chars").select("item_kind", "item_key", "digest", "max_chars", "overlap_chars", "piece_no", "new_pos", "start_pos", "end_pos", "piece").distinct()
    fresh = F.substr("piece", F.col("new_pos") - F.col("start_pos") + 1)
    fits = (F.char_length("piece") <= F.col("max_chars")) & ((F.col("piece_no") == 0) | (F.col("new_pos") - F.col("start_pos") == F.col("overlap_chars")))
    # a group is one text
    parts = pieces.groupBy("item_kind", "item_key", "digest").agg(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("new")))).alias("parts"), F.bool_and(fits).alias("fits"))
    return parts.select("item_kind", "item_key", F.md5(F.array_join(F.transform("parts", lambda p: p["new"]), "")).alias("digest"), "fits").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that came out in more than one piece."""
    pieces = split.with_pieces(p1_items(spark, folder), "content", "max_chars", "overlap_chars")
    return pieces.where("piece_no > 0").select("item_kind", "item_key").distinct()


def p2_items(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_key, text): evidence contents and the texts of scans."""
    units = table(spark, folder, "evidence_units").select(F.lit("evidence").alias("src"), F.col("evidence_id").alias("row_key"), F.col("content").alias("text"))
    scans = table(spark, folder, "ocr_responses").select(F.lit("ocr").alias("src"), F.col("id").alias("row_key"), F.col("md_results").alias("text"))
    return units.unionByName(scans)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention of an e-mail address, telephone number, identity number, address or name."""
    return pii.mentions(p2_items(spark, folder), "text").select("src", "row_key", "entity_type", "start_pos").distinct()


def p2_redacted_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence contents and md_results with typed placeholders for personal information."""
    return pii.with_placeholders(p2_items(spark, folder), "text").select("src", "row_key", "redacted").distinct()


def _scans(spark: SparkSession, folder: str):
    ocr = table(spark, folder, "ocr_responses")
    return ocr.select("id", "md_results", "layout_details"), scans.word_counts(ocr.select("md_results"), "md_results")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every noisy line of scanned documents, in md_results and in the layout elements."""
    return scans.noisy_lines(*_scans(spark, folder)).distinct()


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every md_results, and the content of every layout element, as continuous paragraphs."""
    return scans.repaired_texts(*_scans(spark, folder)).select("item_key", "repaired").distinct()


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "evidence_units").select(F.col("document_id").alias("scope"), F.concat(F.lit("e:"), "evidence_id").alias("item_key"), "content")
    elements = layout_items(spark, folder).select(F.col("document_id").alias("scope"), layout_key().alias("item_key"), "content")
    return units.unionByName(elements)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items of one document that look the same but differ in code points."""
    return unify.look_alike_pairs(materialize(unify.look_alike_groups(p5_items(spark, folder)), "forms"))


def p5_unified_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence unit and layout element with its content in the consistent form."""
    return unify.with_unified(p5_items(spark, folder).select("item_key", "content"), "content").select("item_key", "unified").distinct()


#: Classes are paired in blocks of about so many ids, so that no task has all of a large class.
COPIES = 64


def _p6(spark: SparkSession, folder: str):
    units = table(spark, folder, "evidence_units").select("evidence_id", "content")
    return neardup.near_copies(units, "evidence_id", "content", 0.6, 24)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of evidence units with a similarity of at least 0.6."""
    return p6_pairs(*_p6(spark, folder))


def p6_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(left_id, right_id): all pairs within the classes of ``members(key, form)`` and between those of ``links(form_a, form_b)``.

    Classes of over COPIES ids are parted in blocks of about so many, and blocks are paired, so no
    task has all of a large class, nor all pairs of two large ones.
    """
    sizes = members.groupBy("form").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / COPIES).cast("long")
    large = sizes.where(F.col("size") > COPIES).select("form", blocks.alias("blocks"))
    one = F.coalesce("blocks", F.lit(1).cast("long"))
    placed = members.join(large, "form", "left").select("form", "key", F.pmod(F.xxhash64("key"), one).alias("block"))
    wide = links.select("form_a", "form_b")
    for x in "ab":
        wide = wide.join(large.select(F.col("form").alias(f"form_{x}"), F.col("blocks")), f"form_{x}", "left").withColumn(f"block_{x}", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("blocks")
    a, b = (placed.select(F.col("form").alias(f"form_{x}"), F.col("block").alias(f"block_{x}"), F.col("key").alias(x)) for x in "ab")
    between = wide.join(a, ["form_a", "block_a"]).join(b, ["form_b", "block_b"]).select("a", "b")
    # each id goes, from either side, to the pairs of its own block with every block
    copies = members.join(sizes, "form").withColumn("own", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    left = copies.select("form", F.col("own").alias("block_a"), F.col("other").alias("block_b"), F.col("key").alias("a"))
    right = copies.select("form", F.col("other").alias("block_a"), F.col("own").alias("block_b"), F.col("key").alias("b"))
    within = left.join(right, ["form", "block_a", "block_b"]).where("a < b").select("a", "b")
    pairs = between.unionByName(within).where("a <> b")
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence unit that is compared, with its group, the members of its class, and links to other classes."""
    members, links = _p6(spark, folder)
    linked = components(links.select(F.hex("form_a").alias("a"), F.hex("form_b").alias("b")), "a", "b")
    degree = links.select(F.explode(F.array("form_a", "form_b")).alias("form")).groupBy("form").agg(F.count("*").alias("links"))
    sizes = members.groupBy("form").agg(F.count("*").alias("copies"), F.min("key").alias("head"))
    classes = sizes.join(degree, "form", "left").join(linked.select(F.unhex("node").alias("form"), "component"), "form", "left")
    classes = classes.select("form", "head", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", F.hex("form")).alias("component"))
    names = classes.groupBy("component").agg(F.min("head").alias("group_id"))
    named = classes.join(names, "component").select("form", "group_id", "copies", "links")
    return members.join(named, "form").select(F.col("key").alias("evidence_id"), "group_id", "copies", "links")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode.with_token_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of each document's text as its token ids give it back; of an empty text for null ones."""
    return encode.with_text(p7_ids(spark, folder), "ids").select("doc_id", F.md5("text").alias("digest"), F.char_length("text").alias("chars"))


def _sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, container_kind, capacity_tokens): every document with every kind of container."""
    coded = encode.with_token_ids(table(spark, folder, "documents").select("doc_id", "text"))
    sizes = materialize(coded.select("doc_id", F.size("ids").alias("n_tokens")), "sizes")
    # the kinds are a fixed setting of a few rows, so they go into the plan as literals
    kinds = table(spark, folder, "pack_capacities").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind").collect()
    each = F.array(*[F.struct(F.lit(r[0]).alias("container_kind"), F.lit(r[1]).alias("capacity_tokens")) for r in kinds])
    return sizes.select("doc_id", "n_tokens", F.explode(each).alias("k")).select("doc_id", "n_tokens", "k.container_kind", "k.capacity_tokens")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every document in a container of each kind."""
    out = pack.with_containers(_sized_documents(spark, folder), "doc_id", "n_tokens", "capacity_tokens", "container_kind")
    return out.select(F.col("kind").alias("container_kind"), F.col("container").alias("container_id"), F.col("key").alias("doc_id"), "part", F.col("begin").alias("begin_token"), F.col("size").alias("n_tokens"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container: containers, tokens in them, and the share of room that is used."""
    loads = p8_containers(spark, folder).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("load"))
    total = loads.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
    return total.join(table(spark, folder, "pack_capacities"), "container_kind").select("container_kind", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"))


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    anchors = table(spark, folder, "reading_anchors").select("text", "level").where("text is not null and level is not null").orderBy("anchor_id")
    grader = reading.Grader(reading.rarities(documents, "text")).fit([(r["text"], r["level"]) for r in anchors.collect()])
    return reading.with_level(documents, "text", grader)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of each document of at least 40 words."""
    return _graded(spark, folder).where("level is not null").select("doc_id", "level").distinct()


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and their mean score by level, with those too short to judge."""
    return _graded(spark, folder).groupBy("level").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 3).alias("mean_score"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p1_whole": p1_whole,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p7_ids": p7_ids,
        "p7_decoded": p7_decoded,
        "p8_containers": p8_containers,
        "p8_fill": p8_fill,
        "p9_found": p9_found,
        "p9_profile": p9_profile,
        "p2_found": p2_found,
        "p2_redacted_evidence": p2_redacted_evidence,
        "p4_found": p4_found,
        "p4_repaired": p4_repaired,
        "p5_found": p5_found,
        "p5_unified_evidence": p5_unified_evidence,
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return ORACLE
