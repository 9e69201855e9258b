"""Queries over detection, comparison, evaluation and history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import compare as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import ingest as I
from ..operators import search as R
from ..operators.diff import changed_words, classify, with_ops
from ..session import materialize
from ..sources.tables import table
from . import search as PS
from . import sql as S


def bundles(spark, folder):
    return table(spark, folder, "context_bundles").select("bundle_id", "document_id", "claim", "snippets", "max_chars").distinct()


def joined_bundles(spark, folder):
    return bundles(spark, folder).where("claim is not null").select("bundle_id", "claim", F.coalesce(F.array_join(F.filter("snippets", lambda s: s.isNotNull()), "\n"), F.lit("")).alias("evidence"))


def flags(spark, folder):
    c = D.conflicts(joined_bundles(spark, folder))
    return c.select("bundle_id", F.array_join(F.array_sort("conflicts"), "|").alias("conflicts"), D.severity(F.col("conflicts")).alias("severity"), F.size(F.array_intersect("claim_numbers", "evidence_numbers")).alias("shared_numbers"))


def fact_conflicts(spark, folder):
    """How many evidence units of its document have dates of which none is in a claim.

    Counted as all units with dates less those that share one, so claims and units of a large
    document are never paired up.
    """
    claims = bundles(spark, folder).where("claim is not null").select("bundle_id", "document_id", X.dates("claim").alias("a")).where(F.size("a") > 0).distinct()
    units = I.upserted(table(spark, folder, "evidence_units")).where("content is not null").select("document_id", "evidence_id", X.dates("content").alias("b")).where(F.size("b") > 0)
    dated = units.groupBy("document_id").agg(F.count("*").alias("dated"))
    asked = claims.select("bundle_id", "document_id", F.explode("a").alias("date"))
    held = units.select("document_id", "evidence_id", F.explode("b").alias("date"))
    sharing = asked.join(held, ["document_id", "date"]).groupBy("bundle_id").agg(F.countDistinct("evidence_id").alias("sharing"))
    rows = claims.select("bundle_id", "document_id").join(dated, "document_id").join(sharing, "bundle_id", "left")
    return rows.select("bundle_id", (F.col("dated") - F.coalesce("sharing", F.lit(0))).alias("conflicting_units")).where("conflicting_units > 0")


def detected(spark, folder):
    return D.detect(bundles(spark, folder).withColumnRenamed("bundle_id", "claim_id"))


def pairs(spark, folder):
    """Each document with the one of the next number."""
    docs = table(spark, folder, "evidence_units").select("document_id").distinct().withColumn("n", F.regexp_extract("document_id", r"(\d+)$", 1).cast("long"))
    nxt = docs.select((F.col("n") - 1).alias("n"), F.col("document_id").alias("right_document_id"))
    return docs.join(nxt, "n").select(F.concat_ws("~", "document_id", "right_document_id").alias("pair_id"), F.col("document_id").alias("left_document_id"), "right_document_id")


def run_pairs(spark, folder):
    """Each run of a document with the run before it: two versions of one document."""
    runs = table(spark, folder, "ocr_responses").select("id", "document_id", "created").dropDuplicates(["id"])
    before = F.lag("id").over(Window.partitionBy("document_id").orderBy("created", "id"))
    return runs.withColumn("left_document_id", before).where("left_document_id is not null").select(F.col("id").alias("pair_id"), "left_document_id", F.col("id").alias("right_document_id"))


def run_units(spark, folder):
    """Evidence units of the runs that have another version, each run as a document of its own."""
    p = run_pairs(spark, folder)
    some = p.select(F.col("left_document_id").alias("id")).unionByName(p.select(F.col("right_document_id").alias("id"))).distinct()
    runs = table(spark, folder, "ocr_responses").dropDuplicates(["id"]).join(some, "id", "left_semi")
    return I.evidence_units(runs.withColumn("document_id", F.col("id"))).select("evidence_id", "document_id", "content", "page_number")


def _units(spark, folder):
    return I.upserted(table(spark, folder, "evidence_units")).select("evidence_id", "document_id", "content", "page_number")


def _compared(mode):
    return lambda s, f: C.compare(run_units(s, f), run_pairs(s, f), mode)


def versions(spark, folder):
    """Word differences between the runs of one document, in the order of their making."""
    runs = table(spark, folder, "ocr_responses").select("id", "document_id", "created", "md_results").where("md_results is not null").distinct()
    w = Window.partitionBy("document_id").orderBy("created", "id")
    two = runs.withColumn("before", F.lag("md_results").over(w)).where("before is not null").select("id", "before", F.col("md_results").alias("after"))

    stepped = with_ops(two, "before", "after")
    return stepped.select("id", F.size("ops").alias("steps"), changed_words(F.col("ops")).alias("changed"), classify(F.col("before"), F.col("after"), F.col("ops")).alias("kind"))


def page_band(spark, folder):
    """Units of neighbouring documents on the same page or the next, as counts by pair: a band join on page numbers."""
    u = _units(spark, folder).where("page_number is not null").groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    p = pairs(spark, folder)
    a = p.join(u.select(F.col("document_id").alias("left_document_id"), F.col("page_number").alias("pa"), F.col("n").alias("na")), "left_document_id")
    b = u.select(F.col("document_id").alias("right_document_id"), F.explode(F.array(F.col("page_number") - 1, F.col("page_number"), F.col("page_number") + 1)).alias("pa"), F.col("n").alias("nb"))
    return a.join(b, ["right_document_id", "pa"]).groupBy("pair_id").agg(F.sum(F.col("na") * F.col("nb")).alias("near_pairs"))


def missing_lines(spark, folder):
    """Blocks of a document that its next document has no equal of: an anti join on normalised text."""
    u = _units(spark, folder).withColumn("norm", T.normalized("content")).where(F.char_length("norm") >= 12)
    p = pairs(spark, folder)
    left = u.join(p.select(F.col("left_document_id").alias("document_id"), "right_document_id"), "document_id").select("evidence_id", "right_document_id", "norm")
    right = u.select(F.col("document_id").alias("right_document_id"), "norm").distinct()
    return left.join(right, ["right_document_id", "norm"], "left_anti").select("evidence_id", "right_document_id")


#: Strategies in the order in which the first of equals is the best.
STRATEGIES = ["baseline", "lexical", "semantic", "hybrid", "rg"]
KEYWORD = ["baseline", "lexical", "rg"]
#: Questions of a pack have at most so many characters, as in the reference.
LONGEST = 8192


def _measured(spark, folder, strategies):
    """The measures of each claim by strategy: the texts of its document are relevant. Texts and claims are met once for all keyword strategies."""
    rows, claims = materialize(PS.corpus(spark, folder), "corpus"), PS.every_claim(spark, folder)
    asked = claims.select("query_id", "query")
    ways = {how: 10 for how in KEYWORD if how in strategies or (how == "lexical" and "hybrid" in strategies)}
    counts = materialize(R.topped(rows, asked, ways), "counts")
    keyword = lambda how: R.best(R.scored(counts.where(F.col("how") == how), how), 10)
    vague = materialize(R.semantic(rows, asked, 12), "vague") if "semantic" in strategies else None
    sizes = rows.groupBy("document_id").agg(F.countDistinct("id").alias("texts"))
    out = None
    for how in strategies:
        if how == "semantic":
            hits = vague.where("rank <= 10")
        elif how == "hybrid":
            hits = R.fuse(vague, keyword("lexical").select("query_id", "id", "score", "rank"), 10)
        else:
            hits = keyword(how)
        judged = hits.select("query_id", "id", "rank").join(rows.select("id", "document_id"), "id")
        m = E.by_document(judged, claims.select("query_id", "document_id"), sizes, 10).withColumn("strategy", F.lit(how))
        out = m if out is None else out.unionByName(m)
    return out


def by_strategy(spark, folder, strategies=None):
    return E.means(_measured(spark, folder, strategies or STRATEGIES), "strategy")


def measured(spark, folder):
    return _measured(spark, folder, ["lexical"]).select("query_id", "relevant", "found", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def language_labels(spark, folder):
    """Whether a document is called French against whether its function words say so."""
    d = table(spark, folder, "documents").where("lang is not null and text is not null")
    tok = T.tokens("text")
    count = lambda ws: F.size(F.filter(tok, lambda t: t.isin(*ws)))
    return d.select("doc_id", "source", F.startswith(F.lower("lang"), F.lit("fr")).alias("gold"), (count(["le", "la", "les", "de", "des", "du", "et"]) > count(["the", "of", "and", "to", "in", "shall", "any"])).alias("predicted"))


def experiment_runs(spark, folder):
    """Result rows as a history keeps them: JSON by strategy, here of the sizes and scores of each document's facts."""
    f = table(spark, folder, "normalized_facts").where("confidence is not null and field_type is not null").groupBy("document_id", "field_type").agg(F.round(F.avg("confidence"), 4).alias("recall"), F.round(F.min("confidence"), 4).alias("mrr"), F.round(F.max("confidence"), 4).alias("ndcg"))
    return f.groupBy("document_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field_type", F.struct("recall", "mrr", "ndcg"))))).alias("result")).select(F.col("document_id").alias("run_id"), "result")


QUERIES = {
    "det_conflicts": flags,
    "det_by_document_units": fact_conflicts,
    "det_context": lambda s, f: bundles(s, f).where("claim is not null").select("bundle_id", D.context(F.col("claim"), D.packed(F.col("claim"), F.coalesce("snippets", F.array().cast("array<string>")), F.col("max_chars")), F.col("max_chars")).alias("context")).withColumn("chars", F.char_length("context")),
    "det_clauses": lambda s, f: D.clause_conflicts(joined_bundles(s, f)).select("bundle_id", F.round("clause_similarity", 6).alias("similarity"), "clause_conflict"),
    "det_claims": lambda s, f: detected(s, f).select("claim_id", "document_id", F.array_join("conflicts", ", ").alias("conflicts"), "severity", "advice", "verdict", "compression_ratio", "section_changed"),
    "det_documents": lambda s, f: D.by_document(detected(s, f)),
    "cmp_tokens": lambda s, f: PS.corpus(s, f).select("id", F.size(F.regexp_extract_all("text", F.lit(rf"[^{T.WS}]+|[{T.WS}]+"), 0)).alias("pieces")),
    "cmp_versions": versions,
    "cmp_standard": _compared("standard"),
    "cmp_full_lexical": _compared("full_lexical"),
    "cmp_adaptive": _compared("adaptive"),
    "cmp_groups": lambda s, f: _compared("standard")(s, f).groupBy("subtype").agg(F.count("*").alias("changes"), F.count_if(F.col("importance") == "high").alias("high")),
    "cmp_page_band": page_band,
    "cmp_missing_blocks": missing_lines,
    "evl_retrieval": measured,
    "evl_strategies": by_strategy,
    "evl_keyword_strategies": lambda s, f: by_strategy(s, f, KEYWORD),
    "evl_best_strategy": lambda s, f: E.best_strategy(by_strategy(s, f), STRATEGIES).select("strategy", "recall"),
    "evl_labels": lambda s, f: E.labelled(language_labels(s, f), "gold", "predicted"),
    "evl_labels_by_source": lambda s, f: E.labelled(language_labels(s, f).withColumn("source", F.lower("source")), "gold", "predicted", "source"),
    "evl_tokens": lambda s, f: table(s, f, "ocr_responses").select("id", E.total_tokens(F.col("token_usage.total_tokens"), F.col("token_usage.prompt_tokens"), F.col("token_usage.completion_tokens")).alias("tokens")),
    "evl_usage": lambda s, f: table(s, f, "ocr_responses").groupBy(F.lower("model").alias("model")).agg(F.count("*").alias("runs"), F.sum("token_usage.prompt_tokens").alias("prompt"), F.sum("token_usage.completion_tokens").alias("completion"), F.count_if(F.col("md_results").isNull()).alias("failed")),
    "evl_question_samples": lambda s, f: E.question_pack(bundles(s, f), F.col("claim"), "bundle_id", F.col("snippets"), LONGEST)[0],
    "evl_question_corpus": lambda s, f: E.question_pack(bundles(s, f), F.col("claim"), "bundle_id", F.col("snippets"), LONGEST)[1],
    "evl_two_contexts": lambda s, f: E.two_contexts(bundles(s, f).withColumn("first", F.get("snippets", F.lit(0))).withColumn("second", F.get("snippets", F.lit(1))), "bundle_id", "first", "second"),
    "evl_judged_pairs": lambda s, f: E.judged_pairs(table(s, f, "normalized_facts").select(F.col("document_id").alias("query_id"), F.col("evidence_id").alias("id"), F.col("confidence").alias("relevance")).distinct(), bundles(s, f).groupBy("document_id").agg(F.min("claim").alias("query")).withColumnRenamed("document_id", "query_id"), PS.corpus(s, f)),
    "evl_first_rows": lambda s, f: E.first_rows(bundles(s, f).select("bundle_id", "document_id").distinct(), 20, "bundle_id"),
    "hst_run_summaries": lambda s, f: E.run_summaries(experiment_runs(s, f), "result"),
}

_BUN = "bundles AS (SELECT DISTINCT bundle_id, document_id, claim, snippets, max_chars FROM context_bundles)"
_JB = "(SELECT bundle_id, claim, coalesce(array_to_string(list_filter(snippets, lambda s: s IS NOT NULL), chr(10)), '') AS evidence FROM bundles WHERE claim IS NOT NULL)"


def _sets(x: str) -> dict[str, str]:
    return {"dates": S.distinct_sorted(S.every(x, X.PLAIN_DATE, 1)), "amounts": S.amounts(x, X.NUMBER), "codes": f"list_distinct(list_transform({S.every(S.masked(x), X.CODE)}, lambda v: upper(v)))", "numbers": f"list_distinct({S.every(x, X.NUMBER, 1)})"}


_COLS = ", ".join(f"{e} AS {side[0]}_{n}" for side in ("claim", "evidence") for n, e in _sets(side).items())
_AP = lambda n: f"coalesce(len(c_{n}) > 0 AND len(e_{n}) > 0 AND NOT list_has_any(c_{n}, e_{n}), false)"
_KINDS = (("amount_conflict", "amounts", 4, 4), ("date_conflict", "dates", 3, 3), ("reference_mismatch", "codes", 2, 2), ("table_conflict", "numbers", 1, 3))
_SEV = "CASE WHEN {h} >= 4 OR {w} >= 8 THEN 'critical' WHEN {h} >= 3 OR {w} >= 5 THEN 'high' WHEN {h} >= 2 OR {w} >= 2 THEN 'medium' ELSE 'low' END"
_H = "greatest(" + ", ".join(f"CASE WHEN {_AP(n)} THEN {h} ELSE 0 END" for _, n, _, h in _KINDS) + ")"
_W = " + ".join(f"CASE WHEN {_AP(n)} THEN {w} ELSE 0 END" for _, n, w, _ in _KINDS)
_PAIRS = "docs AS (SELECT DISTINCT document_id, CAST(regexp_extract(document_id, '(\\d+)$', 1) AS BIGINT) AS n FROM evidence_units), pairs AS (SELECT a.document_id || '~' || b.document_id AS pair_id, a.document_id AS l, b.document_id AS r FROM docs a JOIN docs b ON b.n = a.n + 1)"
_UNITS = "units AS (SELECT evidence_id, document_id, content, page_number FROM evidence_units QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at DESC NULLS LAST, content DESC NULLS LAST) = 1)"
_BASE = f"{PS._CORPUS}, {PS._EVERY_CLAIM}, {PS._SIDES}"


def _measures(how: str) -> str:
    return f"SELECT query_id, relevant, coalesce(found, 0) AS found, coalesce(found, 0) / relevant::DOUBLE AS recall, coalesce(1 / first::DOUBLE, 0) AS reciprocal_rank, CASE WHEN ideal > 0 THEN least(1.0, coalesce(gain, 0) / ideal) ELSE 0 END AS ndcg FROM (SELECT query_id, count(*) AS relevant, sum(CASE WHEN n <= 10 THEN 1 / log2(n + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM (SELECT q.query_id, c.id FROM corpus c JOIN claims q USING (document_id))) GROUP BY 1) LEFT JOIN (SELECT h.query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM ({PS._top(PS._scored(how), 10)}) h WHERE h.document_id = h.own GROUP BY 1) USING (query_id)"


_MEAN = "count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"
_STRAT = " UNION ALL ".join(f"SELECT '{h}' AS strategy, {_MEAN} FROM ({_measures(h)})" for h in KEYWORD)
_LABELS = "(SELECT doc_id, lower(source) AS source, starts_with(lower(lang), 'fr') AS gold, len(list_filter(t, lambda x: x IN ('le', 'la', 'les', 'de', 'des', 'du', 'et'))) > len(list_filter(t, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'shall', 'any'))) AS predicted FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL))"


def _labels(by: str) -> str:
    head = f"{by}, " if by else ""
    return f"SELECT {head}tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM (SELECT {head}count_if(gold AND predicted) AS tp, count_if(NOT gold AND predicted) AS fp, count_if(gold AND NOT predicted) AS fn, count_if(NOT gold AND NOT predicted) AS tn FROM {_LABELS} {'GROUP BY ' + by if by else ''}))"


_Q = f"trim(regexp_replace(claim, '[{S.WS}]+', ' ', 'g'))"
_EV = f"ev AS (SELECT CAST(bundle_id AS VARCHAR) AS sample_id, q, 'find-' || bundle_id || '-ev-' || (i - 1) AS id, snippets[i] AS text FROM (SELECT *, {_Q} AS q, unnest(generate_series(1, len(snippets))) AS i FROM bundles) WHERE q <> '' AND length(q) <= 8192 AND snippets[i] IS NOT NULL AND snippets[i] <> '')"
_RUNS = "(SELECT document_id AS run_id, count(*) AS strategies, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT document_id, field_type, round(avg(confidence), 4) AS recall, round(min(confidence), 4) AS mrr, round(max(confidence), 4) AS ndcg FROM normalized_facts WHERE confidence IS NOT NULL AND field_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
ORACLE = {
    "det_conflicts": f"WITH {_BUN} SELECT bundle_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {_AP(n)} THEN {S.quoted(k)} END' for k, n, _, _ in _KINDS)}], lambda k: k IS NOT NULL), '|') AS conflicts, {_SEV.format(h=_H, w='(' + _W + ')')} AS severity, len(list_intersect(c_numbers, e_numbers)) AS shared_numbers FROM (SELECT bundle_id, {_COLS} FROM {_JB})",
    "det_by_document_units": f"WITH {_BUN}, {_UNITS} SELECT bundle_id, count(*) AS conflicting_units FROM (SELECT bundle_id, document_id, {_sets('claim')['dates']} AS a FROM bundles WHERE claim IS NOT NULL) x JOIN (SELECT document_id, {_sets('content')['dates']} AS b FROM units WHERE content IS NOT NULL) y USING (document_id) WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) GROUP BY 1",
    "cmp_tokens": f"WITH {PS._CORPUS} SELECT id, len(regexp_extract_all(text, '[^{S.WS}]+|[{S.WS}]+')) AS pieces FROM corpus",
    "cmp_page_band": f"WITH {_UNITS}, {_PAIRS} SELECT pair_id, count(*) AS near_pairs FROM pairs JOIN units a ON a.document_id = l JOIN units b ON b.document_id = r WHERE abs(a.page_number - b.page_number) <= 1 GROUP BY 1",
    "cmp_missing_blocks": f"WITH {_UNITS}, {_PAIRS}, norms AS (SELECT evidence_id, document_id, {S.normalized('content')} AS norm FROM units) SELECT evidence_id, r AS right_document_id FROM norms a JOIN pairs ON l = document_id WHERE length(norm) >= 12 AND NOT EXISTS (SELECT 1 FROM norms b WHERE b.document_id = r AND b.norm = a.norm)",
    "evl_retrieval": f"WITH {_BASE} SELECT query_id, relevant, found, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM ({_measures('lexical')})",
    "evl_keyword_strategies": f"WITH {_BASE} {_STRAT}",
    "evl_labels": _labels(""),
    "evl_labels_by_source": _labels("source"),
    "evl_tokens": "SELECT id, coalesce(nullif(token_usage.total_tokens, 0), coalesce(token_usage.prompt_tokens, 0) + coalesce(token_usage.completion_tokens, 0)) AS tokens FROM ocr_responses",
    "evl_usage": "SELECT lower(model) AS model, count(*) AS runs, sum(token_usage.prompt_tokens) AS prompt, sum(token_usage.completion_tokens) AS completion, count_if(md_results IS NULL) AS failed FROM ocr_responses GROUP BY 1",
    "evl_question_samples": f"WITH {_BUN}, {_EV} SELECT DISTINCT sample_id, q AS query FROM ev",
    "evl_question_corpus": f"WITH {_BUN}, {_EV} SELECT id, min(text) AS text FROM ev GROUP BY 1",
    "evl_two_contexts": f"WITH {_BUN} SELECT bundle_id || ':context' || i AS id, snippets[i] AS text FROM (SELECT *, unnest([1, 2]) AS i FROM bundles) WHERE snippets[i] IS NOT NULL AND snippets[i] <> ''",
    "evl_judged_pairs": f"WITH {_BUN}, {_UNITS} SELECT q.document_id AS query_id, q.query, f.evidence_id AS id, f.confidence AS relevance FROM (SELECT DISTINCT document_id, evidence_id, confidence FROM normalized_facts) f JOIN (SELECT document_id, min(claim) AS query FROM bundles GROUP BY 1) q USING (document_id) WHERE f.evidence_id IN (SELECT evidence_id FROM units)",
    "evl_first_rows": f"WITH {_BUN} SELECT DISTINCT bundle_id, document_id FROM bundles ORDER BY bundle_id LIMIT 20",
    "hst_run_summaries": f"SELECT * FROM {_RUNS}",
}
