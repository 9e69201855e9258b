"""Queries over what is shown of changes, claims, runs and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import compare as C
from ..operators import detect as D
from ..operators import diff as W
from ..operators import evaluate as E
from ..operators import ingest as I
from ..operators import report as P
from ..operators import search as R
from ..session import materialize, scratch
from ..sources import runs as U
from ..sources.tables import table
from . import ingest as PI
from . import review as V
from . import search as PS
from . import sql as S


def fact_changes(spark, folder):
    """Changes between the facts of one subject, each against the one before of its type: values short enough to be classified as a whole."""
    f = table(spark, folder, "normalized_facts").select("fact_id", "document_id", "evidence_id", "subject_key", "field_type", "raw_value", "normalized_value", "confidence").distinct().where("raw_value is not null and normalized_value is not null")
    w = Window.partitionBy("document_id", "subject_key", "field_type").orderBy("fact_id")
    two = f.select(F.col("document_id").alias("pair_id"), "fact_id", "field_type", "confidence", *[F.lag(c).over(w).alias(f"left_{n}") for c, n in (("raw_value", "raw"), ("normalized_value", "normalized"), ("evidence_id", "id"))], F.col("raw_value").alias("right_raw"), F.col("normalized_value").alias("right_normalized"), F.col("evidence_id").alias("right_id"))
    some = two.where("left_raw is not null and left_normalized <> right_normalized")
    none = F.array().cast("array<struct<op:string,text:string>>")
    rows = some.withColumn("ops", none).withColumn("subtype", W.classify(F.col("left_raw"), F.col("right_raw"), F.col("ops")))
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("fact_id"))
    return rows.select("pair_id", number.alias("number"), C.title(F.col("subtype"), F.col("field_type"), F.lit(None)).alias("title"), C.summary(F.col("subtype"), F.col("left_raw"), F.col("right_raw"), F.col("ops")).alias("summary"), "subtype", C.importance(F.col("subtype")).alias("importance"), "field_type", "left_raw", "right_raw", "left_normalized", "right_normalized", F.pmod("fact_id", F.lit(3)).cast("int").alias("left_page"), F.pmod("fact_id", F.lit(5)).cast("int").alias("right_page"), F.col("confidence"), "ops")


def claim_sides(spark, folder):
    """Each claim with its own document (side l) and the next one (side r)."""
    q = PS.claims(spark, folder).join(V.pairs(spark, folder).withColumnRenamed("left_document_id", "document_id"), "document_id")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("document_id").alias("d")), F.struct(F.lit("r").alias("side"), F.col("right_document_id").alias("d")))).alias("s")
    return q.select("query_id", "query", sides).select("query_id", "query", "s.side", F.col("s.d").alias("document_id"))


def claim_hits(spark, folder):
    """The three best texts of either document for each claim; where one has none by keywords, those in which words of the claim stand."""
    rows, sides = materialize(PS.corpus(spark, folder), "corpus"), materialize(claim_sides(spark, folder), "sides")
    asked = sides.select("query_id", "query", "document_id")
    first = R.keyword(rows, asked, 3, "lexical", "document_id").select("query_id", "document_id", "id", "rank", "score")
    empty = asked.join(first.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti")
    found = first.unionByName(R.keyword(rows, empty, 3, "rg", "document_id").select("query_id", "document_id", "id", "rank", "score"))
    return found.join(sides.select("query_id", "document_id", "side"), ["query_id", "document_id"])


def claim_pairs(spark, folder):
    units = I.upserted(table(spark, folder, "evidence_units")).select(F.col("evidence_id").alias("id"), F.col("content").alias("text"), F.col("page_number").alias("page"))
    claims = PS.claims(spark, folder).select("query_id", F.col("query").alias("claim"), T.category("query").alias("category"))
    rows = claim_hits(spark, folder).join(units, "id").join(claims, "query_id")
    hits = materialize(rows.select(F.col("query_id").alias("claim_id"), "claim", "category", "side", "id", "text", "page", "score"), "hits")
    return claims, materialize(C.claim_pairs(hits), "pairs")


def claimed(spark, folder):
    claims, pairs = claim_pairs(spark, folder)
    return C.compare_claims(claims.select(F.col("query_id").alias("claim_id"), "category"), pairs)


def rows_of_runs(spark, folder):
    """The rows that documents enter a comparison with: blocks and their first sentences."""
    units = I.upserted(table(spark, folder, "evidence_units")).select("evidence_id", "document_id", "content", "page_number")
    return C.diff_rows(units, C.STANDARD).select("document_id", "at", "id", "kind", "score", F.md5("text").alias("text"), "page", "hint")


def highlights(spark, folder):
    e = I.layout_elements(table(spark, folder, "ocr_responses"), "id").select(F.col("id").alias("document_id"), "page", "element", "box")
    return P.highlights(e, 1).select("document_id", "element", "left", "top", "width", "height")


def salvaged(spark, folder):
    """Answers in three forms: JSON, JSON within text, and text; read back."""
    b = V.bundles(spark, folder).where("claim is not null").select("bundle_id", "claim").distinct()
    js = F.to_json(F.struct(F.lit("inconsistent").alias("verdict"), F.lit("high").alias("severity"), (F.col("bundle_id") % 10 / 10.0).alias("confidence"), F.concat(F.lit("s"), F.col("bundle_id").cast("string")).alias("summary")))
    form = F.col("bundle_id") % 3
    answer = F.when(form == 0, js).when(form == 1, F.concat(F.lit("Here it is: "), js, F.lit(" as asked."))).otherwise(F.replace(F.replace("claim", F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")")))
    return b.select("bundle_id", P.verdict_of(answer).alias("v")).select("bundle_id", "v.verdict", "v.severity", "v.confidence", "v.summary")


def plain_detection(spark, folder):
    return D.detect(V.bundles(spark, folder).withColumnRenamed("bundle_id", "claim_id"), alike=False)


def samples(spark, folder):
    """Economics samples: the runs of OCR with what their tokens cost and how much shorter the text is than its layout."""
    o = table(spark, folder, "ocr_responses").select("id", "model", "md_results", "token_usage").distinct()
    p, c = F.col("token_usage.prompt_tokens"), F.col("token_usage.completion_tokens")
    return o.select(F.lower("model").alias("model"), p.alias("prompt_tokens"), c.alias("completion_tokens"), E.cost(p, c, 0.5, 1.5).alias("cost_usd"), (F.coalesce(p, F.lit(0)) % 1000).alias("latency_ms"), F.when(F.col("md_results").isNotNull(), F.lit(1)).otherwise(0).alias("llm_calls"))


def hits_judged(spark, folder):
    rows = materialize(PS.corpus(spark, folder), "corpus")
    q = PS.claims(spark, folder)
    hits = R.keyword(rows, q.select("query_id", "query"), 10, "lexical").join(rows.select("id", "document_id"), "id")
    return E.judged_hits(hits.select("query_id", "id", "rank", "score", "document_id"), q.select("query_id", "document_id")).select("query_id", "id", "rank", "score", "is_relevant", "gold_present", "best_relevant_rank")


def _dated_runs(spark, folder):
    """Runs as a history keeps them, made when the last evidence of their document was taken."""
    at = table(spark, folder, "evidence_units").where("extracted_at is not null").groupBy(F.col("document_id").alias("run_id")).agg(F.max("extracted_at").cast("timestamp").alias("created_at"))
    return V.experiment_runs(spark, folder).join(at, "run_id")


def stored_runs(spark, folder):
    """Runs saved to a store, and the latest 25 of it."""
    path = scratch(spark, "runs")
    U.save_run(_dated_runs(spark, folder), path, "experiment")
    return U.list_runs(spark, path, 25).select("run_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "kind", F.char_length("result").alias("chars"))


def comparison_runs(spark, folder):
    """Comparison runs by their log: here the status rows of documents, as runs of a document against itself."""
    s = table(spark, folder, "status_log").where("arrived_at is not null").select(F.col("document_id").alias("run_id"), F.col("document_id").alias("left_document_id"), F.col("document_id").alias("right_document_id"), F.lower("status").alias("status"), "error", F.lit(None).cast("string").alias("result"), F.col("arrived_at").alias("at"))
    return U.latest_comparisons(s).select("run_id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def summed(spark, folder):
    runs = _dated_runs(spark, folder)
    s = E.run_summaries(runs, "result").join(runs.select("run_id", "created_at"), "run_id")
    return E.trend(s).select("step", "run_id", "recall", "mrr", "ndcg", "recall_change")


def history(spark, folder):
    runs = _dated_runs(spark, folder)
    shape = "map<string, struct<recall: double, mrr: double, ndcg: double>>"
    each = runs.select("run_id", F.explode(F.from_json("result", shape)).alias("strategy", "m")).select("run_id", "strategy", F.col("m.recall").alias("recall"), F.lit(0.0).alias("latency"))
    return E.history_summary(runs.select("run_id", "created_at"), each)


QUERIES = {
    "cmp_fact_changes": lambda s, f: fact_changes(s, f).drop("ops"),
    "cmp_fact_groups": lambda s, f: P.groups(fact_changes(s, f)),
    "cmp_fact_summaries": lambda s, f: P.summaries(fact_changes(s, f)),
    "cmp_fact_issues": lambda s, f: P.issues(fact_changes(s, f)),
    "cmp_important_tokens": lambda s, f: P.important_tokens(fact_changes(s, f)),
    "cmp_highlights": highlights,
    "cmp_best_blocks": lambda s, f: P.best_blocks(I.upserted(table(s, f, "evidence_units"))),
    "cmp_answers": salvaged,
    "cmp_rows": rows_of_runs,
    "cmp_claim_hits": lambda s, f: claim_hits(s, f).select("query_id", "side", "id", "rank", "score"),
    "cmp_claims": claimed,
    "cmp_alignments": lambda s, f: C.alignments(claim_pairs(s, f)[1]),
    "cmp_severity": lambda s, f: V.bundles(s, f).where("claim is not null").select("bundle_id", T.category("claim").alias("category")).distinct().select("bundle_id", "category", C.severity_of(F.col("category")).alias("severity")),
    "det_evidence": lambda s, f: D.evidence(V.bundles(s, f)).select("bundle_id", F.md5("evidence").alias("evidence"), F.md5("section").alias("section"), F.size("parts").alias("parts")),
    "det_checked": lambda s, f: plain_detection(s, f).select("claim_id", "document_id", "conflict_types", "severity", "advice", "verdict", "compression_ratio"),
    "det_rollup": lambda s, f: D.by_document(plain_detection(s, f)),
    "det_escalated": lambda s, f: D.escalated(plain_detection(s, f)).select("claim_id", "severity", "fallback.verdict", "fallback.decided_by", "fallback.needs_review"),
    "evl_cost": lambda s, f: table(s, f, "ocr_responses").select("id", F.round(E.cost(F.col("token_usage.prompt_tokens"), F.col("token_usage.completion_tokens"), 0.5, 1.5), 6).alias("cost")),
    "evl_economics": lambda s, f: E.economics(samples(s, f)),
    "evl_economics_by_model": lambda s, f: E.economics(samples(s, f), "model"),
    "evl_hits": hits_judged,
    "evl_trend": summed,
    "hst_history": history,
    "hst_runs": stored_runs,
    "hst_comparisons": comparison_runs,
    "src_page_tables": lambda s, f: U.page_tables(table(s, f, "parsed_pages")),
    "src_pages": lambda s, f: U.page_texts(table(s, f, "parsed_pages")),
}

_RE = {k: S.quoted(X.spaced(p, S.WS)) for k, p in W.KINDS.items()}
_BOTH = lambda k: f"(regexp_matches(l, {_RE[k]}) AND regexp_matches(r, {_RE[k]}))"
_SHORT = f"greatest(length({S.trimmed('l')}), length({S.trimmed('r')})) <= {W.VALUE_CHARS} AND NOT contains(l, chr(10)) AND NOT contains(r, chr(10)) AND {S.trimmed('l')} <> {S.trimmed('r')}"
_KIND = "CASE " + " ".join(f"WHEN {_SHORT} AND {_BOTH(k)} THEN '{k}'" for k in W.KINDS) + f" WHEN {S.contains_any("lower(l || chr(10) || r)", W.CLAUSE_WORDS)} THEN 'clause_change' ELSE 'text_change' END"
_WORD = "array_to_string(list_transform(string_split(replace(field_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' modifié'"
_TITLE = "CASE subtype " + " ".join(f"WHEN '{k}' THEN {S.quoted(v)}" for k, v in C.TITLES.items()) + f" ELSE {_WORD} END"
_SAID = lambda form, a, b: "concat(" + ", ".join(x for pair in zip((S.quoted(p) for p in form.split("%s")), (a, b, "''")) for x in pair) + ")"
_SUMMARY = "CASE subtype " + " ".join(f"WHEN '{k}' THEN {_SAID(v, S.trimmed('left_raw'), S.trimmed('right_raw'))}" for k, v in C.SUMMARIES.items()) + f" ELSE {S.quoted(C.REWORDED)} END"
_CHANGES = f"""changes AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY fact_id) AS number, {_TITLE} AS title, {_SUMMARY} AS summary, subtype, CASE WHEN subtype IN ('numeric_change', 'date_change', 'reference_change') THEN 'high' ELSE 'medium' END AS importance, field_type, left_raw, right_raw, left_normalized, right_normalized, fact_id % 3 AS left_page, fact_id % 5 AS right_page, confidence
FROM (SELECT *, l AS left_raw, r AS right_raw, {_KIND} AS subtype FROM (SELECT document_id AS pair_id, fact_id, field_type, confidence, lag(raw_value) OVER w AS l, lag(normalized_value) OVER w AS left_normalized, raw_value AS r, normalized_value AS right_normalized FROM (SELECT DISTINCT fact_id, document_id, evidence_id, subject_key, field_type, raw_value, normalized_value, confidence FROM normalized_facts WHERE raw_value IS NOT NULL AND normalized_value IS NOT NULL) WINDOW w AS (PARTITION BY document_id, subject_key, field_type ORDER BY fact_id)) WHERE l IS NOT NULL AND left_normalized <> right_normalized))"""
_PAGE = "coalesce(nullif(left_page, 0), nullif(right_page, 0), 0)"
_VAL = lambda side: f"trim(regexp_replace(coalesce(nullif({side}_normalized, ''), {side}_raw), '[{S.WS}]+', ' ', 'g'))"
_CUT = lambda x: f"CASE WHEN length({x}) <= 72 THEN {x} ELSE rtrim(left({x}, 71)) || '…' END"
_EXPLAINED = "CASE " + " ".join(f"WHEN subtype = '{k}' AND {_VAL('left')} <> '' AND {_VAL('right')} <> '' THEN {_SAID(v, _CUT(_VAL('left')), _CUT(_VAL('right')))}" for k, v in P.EXPLAINED.items()) + " ELSE summary END"
_PARTS = f"list_filter(coalesce(snippets, []), lambda s: s IS NOT NULL AND {S.trimmed('s')} <> '')"
_EVID = f"(SELECT bundle_id, document_id, claim, max_chars, p AS parts, array_to_string(p[1:8], chr(10)) AS evidence, coalesce(p[1], '') AS section FROM (SELECT *, {_PARTS} AS p FROM bundles WHERE claim IS NOT NULL))"


def _context_sql(rows: str, key: str, snippets: str, extra: str = "") -> str:
    steps, state = [], "s0"
    steps.append(f"s0 AS (SELECT *, list_filter(list_transform({snippets}, lambda s: {S.trimmed('s')}), lambda s: s IS NOT NULL AND s <> '') AS sn, max_chars - length(claim) AS room, []::VARCHAR[] AS kept FROM {rows})")
    for k in range(1, 6):
        fits = f"length(sn[{k}]) + 5 <= room"
        steps.append(f"s{k} AS (SELECT * EXCLUDE (room, kept), CASE WHEN len(sn) < {k} OR room <= 0 THEN room WHEN {fits} THEN room - length(sn[{k}]) - 5 ELSE 0 END AS room, CASE WHEN len(sn) < {k} OR room <= 0 THEN kept WHEN {fits} THEN list_append(kept, sn[{k}]) ELSE list_append(kept, left(sn[{k}], greatest(0, room - 3)) || '...') END AS kept FROM {state})")
        state = f"s{k}"
    joined = S.trimmed("array_to_string(list_concat([claim], kept), chr(10) || '---' || chr(10))")
    steps.append(f"packed AS (SELECT *, CASE WHEN length({joined}) <= max_chars THEN {joined} ELSE rtrim(left({joined}, max_chars)) || '...' END AS context FROM {state})")
    return ", ".join(steps)


_CTX = _context_sql("(SELECT * FROM bundles WHERE claim IS NOT NULL)", "bundle_id", "coalesce(snippets, [])")
_DCTX = _context_sql("evid", "bundle_id", "parts[1:3]")
_DET = f"""{V._BUN}, evid AS {_EVID}, {_DCTX}, flags AS (SELECT *, {V._H} AS top, {V._W} AS total, array_to_string(list_filter([{', '.join(f"CASE WHEN {V._AP(n)} THEN '{k}' END" for k, n in (("date_conflict", "dates"), ("amount_conflict", "amounts"), ("reference_mismatch", "codes"), ("table_conflict", "numbers")))}], lambda k: k IS NOT NULL), ', ') AS conflict_types FROM (SELECT *, {V._COLS} FROM packed)),
det AS (SELECT bundle_id AS claim_id, document_id, conflict_types, top, total, {V._SEV.format(h='top', w='total')} AS severity, round(CASE WHEN raw <= 0 THEN 1.0 ELSE length(context) / raw::DOUBLE END, 4) AS compression_ratio FROM (SELECT *, length(claim || array_to_string(kept, '')) AS raw FROM flags))"""
_ADVICE = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ADVICE.items()) + " END"
_SIDESQL = "cs AS (SELECT query_id, query, l AS document_id, 'l' AS side FROM base JOIN pairs ON base.document_id = l UNION ALL SELECT query_id, query, r, 'r' FROM base JOIN pairs ON base.document_id = l)"
_HITS = f"WITH {V._PAIRS.replace('docs', 'numbered')}, {PS._CORPUS}, {PS._CLAIMS.replace('claims AS', 'base AS')}, {_SIDESQL}, claims AS (SELECT query_id || '~' || side AS query_id, query, document_id FROM cs), {PS._SIDES}"
_SAMPLES = "(SELECT lower(model) AS model, token_usage.prompt_tokens AS p, token_usage.completion_tokens AS c, md_results FROM (SELECT DISTINCT id, model, md_results, token_usage FROM ocr_responses))"
_ECON = "count(*) AS runs, coalesce(sum(coalesce(p, 0)), 0)::DOUBLE AS total_prompt_tokens, coalesce(sum(coalesce(c, 0)), 0)::DOUBLE AS total_completion_tokens, coalesce(sum(coalesce(p, 0) + coalesce(c, 0)), 0)::DOUBLE AS total_tokens, round(sum(coalesce(p, 0) / 1000.0::DOUBLE * 0.5::DOUBLE + coalesce(c, 0) / 1000.0::DOUBLE * 1.5::DOUBLE), 6) AS total_cost_usd, round(avg(coalesce(p, 0) % 1000), 6) AS avg_latency_ms, 1.0::DOUBLE AS avg_compression_ratio, sum(CASE WHEN md_results IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS total_llm_calls"
_ATS = "(SELECT document_id AS run_id, max(extracted_at) AS created_at FROM evidence_units WHERE extracted_at IS NOT NULL GROUP BY 1)"
_FACTRUNS = "(SELECT document_id AS run_id, field_type AS strategy, round(avg(confidence), 4) AS recall, round(min(confidence), 4) AS mrr, round(max(confidence), 4) AS ndcg FROM normalized_facts WHERE confidence IS NOT NULL AND field_type IS NOT NULL GROUP BY 1, 2)"
_PAGES = "(SELECT * FROM parsed_pages QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY parsed_at DESC NULLS LAST, text DESC NULLS LAST) = 1)"


def _row_sql(rows: int, sentences: int) -> str:
    hint = _hint("text")
    parts = S.chunks("text", ".!?;:")
    return f"""WITH {V._UNITS}, paged AS (SELECT document_id, evidence_id, coalesce(page_number, 0) AS page, {S.trimmed('content')} AS text, dense_rank() OVER (PARTITION BY document_id ORDER BY coalesce(page_number, 0), evidence_id) - 1 AS position FROM units),
usable AS (SELECT *, round(greatest(0.05::DOUBLE, 1.0::DOUBLE - position * 0.03::DOUBLE), 6) AS base, row_number() OVER (PARTITION BY document_id ORDER BY position) AS n FROM paged WHERE length(text) >= 8),
parted AS (SELECT *, list_concat([struct_pack(k := 0, t := text)], list_filter(list_transform({parts}[1:{sentences}], lambda x, i: struct_pack(k := i::INT, t := x)), lambda p: length(p.t) >= 18)) AS ps FROM usable WHERE n <= {rows}),
each AS (SELECT *, unnest(ps) AS p FROM parted)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n, p.k) - 1 AS at, CASE WHEN p.k > 0 THEN evidence_id || ':s' || p.k ELSE evidence_id END AS id, CASE WHEN p.k > 0 THEN 'sentence' ELSE 'block' END AS kind, CASE WHEN p.k > 0 THEN round(greatest(0.04::DOUBLE, base - p.k * 0.08::DOUBLE), 6) ELSE base END AS score, md5(p.t) AS text, page, {hint} AS hint FROM each QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n, p.k) <= {rows}"""


def _hint(x: str) -> str:
    from .text import _hint_sql

    return _hint_sql(x)


_HIGH = f"SELECT id AS document_id, element, round(x1 * 100, 4)::DOUBLE::VARCHAR || '%' AS \"left\", round(y1 * 100, 4)::DOUBLE::VARCHAR || '%' AS top, round(greatest(0.0, x2 - x1) * 100, 4)::DOUBLE::VARCHAR || '%' AS width, round(greatest(0.0, y2 - y1) * 100, 4)::DOUBLE::VARCHAR || '%' AS height FROM (SELECT id, page, element, {', '.join(PI._box(k).replace('round(', '(').replace(', 6)', ')') for k in ('x1', 'y1', 'x2', 'y2'))} FROM {PI._ELEMENTS.format(src='ocr_responses')} WHERE {PI._B} IS NOT NULL AND {PI._B}.x1 IS NOT NULL AND {PI._B}.y1 IS NOT NULL AND {PI._B}.x2 IS NOT NULL AND {PI._B}.y2 IS NOT NULL) WHERE page = 1"
ORACLE = {
    "cmp_fact_changes": f"WITH {_CHANGES} SELECT * FROM changes",
    "cmp_fact_groups": f"WITH {_CHANGES} SELECT pair_id, subtype, n AS changes, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, subtype) AS place FROM (SELECT pair_id, subtype, count(*) AS n FROM changes GROUP BY 1, 2)",
    "cmp_fact_summaries": f"WITH {_CHANGES} SELECT pair_id, string_agg('- ' || title || ': ' || {_EXPLAINED}, chr(10) ORDER BY k) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE importance WHEN 'high' THEN 3 ELSE 2 END DESC, {_PAGE}, number) AS k FROM changes) WHERE k <= 3 GROUP BY 1",
    "cmp_fact_issues": f"WITH {_CHANGES} SELECT pair_id, 'issue-' || number AS issue_id, title AS claim, field_type AS category, 'inconsistent' AS verdict, importance AS severity, confidence, summary, CASE WHEN confidence >= 0.5 THEN 'high' ELSE 'medium' END AS evidence_quality, abs(left_page - right_page) AS position_delta FROM changes",
    "cmp_important_tokens": f"WITH {_CHANGES} SELECT DISTINCT pair_id, unnest([lower(title), lower(subtype), lower(field_type)]) AS token FROM changes WHERE importance = 'high'",
    "cmp_highlights": _HIGH,
    "cmp_best_blocks": f"WITH {V._UNITS} SELECT document_id, category, min(evidence_id) AS evidence_id, hits FROM (SELECT *, max(hits) OVER (PARTITION BY document_id, category) AS most FROM (SELECT document_id, evidence_id, unnest([{', '.join(S.quoted(k) for k in T.KEYWORDS)}]) AS category, unnest([{', '.join(f'len(list_filter([{", ".join(S.quoted(w) for w in ws)}], lambda w: contains(lower(content), w)))' for ws in T.KEYWORDS.values())}]) AS hits FROM units WHERE content IS NOT NULL) WHERE hits > 0) WHERE hits = most GROUP BY 1, 2, 4",
    "cmp_answers": f"WITH {V._BUN} SELECT DISTINCT bundle_id, CASE WHEN bundle_id % 3 < 2 THEN 'inconsistent' ELSE 'insufficient_evidence' END AS verdict, CASE WHEN bundle_id % 3 < 2 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN bundle_id % 3 < 2 THEN (bundle_id % 10) / 10.0::DOUBLE END AS confidence, CASE WHEN bundle_id % 3 < 2 THEN 's' || bundle_id ELSE left({S.trimmed("replace(replace(claim, '{', '('), '}', ')')")}, 500) END AS summary FROM bundles WHERE claim IS NOT NULL",
    "cmp_rows": _row_sql(18, 2),
    "cmp_claim_hits": f"{_HITS} SELECT string_split(query_id, '~')[1] AS query_id, string_split(query_id, '~')[2] AS side, id, rank, score FROM ({PS._top(PS._scored('lexical', 'AND d.document_id = q.document_id'), 3)}) UNION ALL SELECT string_split(query_id, '~')[1], string_split(query_id, '~')[2], id, rank, score FROM ({PS._top(PS._scored('rg', "AND d.document_id = q.document_id AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.document_id = q.document_id AND list_has_any(o.tok, q.tok))"), 3)})",
    "cmp_severity": f"WITH {V._BUN} SELECT bundle_id, category, CASE WHEN category IN ('liability', 'effective_date', 'payment') THEN 'high' ELSE 'medium' END AS severity FROM (SELECT DISTINCT bundle_id, {S.category('claim', X.MONEY, X.DATE)} AS category FROM bundles WHERE claim IS NOT NULL)",
    "det_evidence": f"WITH {V._BUN} SELECT bundle_id, md5(evidence) AS evidence, md5(section) AS section, len(parts) AS parts FROM {_EVID}",
    "det_context": f"WITH {V._BUN}, {_CTX} SELECT bundle_id, context, length(context) AS chars FROM packed",
    "det_checked": f"WITH {_DET} SELECT claim_id, document_id, conflict_types, severity, {_ADVICE} AS advice, CASE WHEN conflict_types <> '' THEN 'inconsistent' ELSE 'consistent' END AS verdict, compression_ratio FROM det",
    "det_rollup": f"WITH {_DET} SELECT document_id, claims, conflict_count, mean_compression, severity, severity IN ('high', 'critical') AS judge_required FROM (SELECT *, {V._SEV.format(h='top', w='total')} AS severity FROM (SELECT document_id, count(*) AS claims, sum(CASE WHEN conflict_types = '' THEN 0 ELSE len(string_split(conflict_types, ', ')) END) AS conflict_count, round(avg(compression_ratio), 4) AS mean_compression, max(top) AS top, sum(total) AS total FROM det GROUP BY 1))",
    "det_escalated": f"WITH {_DET} SELECT claim_id, severity, CASE WHEN conflict_types <> '' THEN 'inconsistent' ELSE 'consistent' END AS verdict, 'local_rules' AS decided_by, true AS needs_review FROM det WHERE severity IN ('high', 'critical')",
    "evl_cost": "SELECT id, round(coalesce(token_usage.prompt_tokens, 0) / 1000.0::DOUBLE * 0.5::DOUBLE + coalesce(token_usage.completion_tokens, 0) / 1000.0::DOUBLE * 1.5::DOUBLE, 6) AS cost FROM ocr_responses",
    "evl_economics": f"SELECT {_ECON} FROM {_SAMPLES}",
    "evl_economics_by_model": f"SELECT model, {_ECON} FROM {_SAMPLES} GROUP BY 1",
    "evl_hits": f"WITH {PS._CORPUS}, {PS._CLAIMS}, {PS._SIDES} SELECT query_id, id, rank, score, document_id = own AS is_relevant, min(CASE WHEN document_id = own THEN rank END) OVER (PARTITION BY query_id) AS best_relevant_rank, bool_or(document_id = own) OVER (PARTITION BY query_id) AS gold_present FROM ({PS._top(PS._scored('lexical'), 10)})",
    "evl_trend": f"SELECT step, run_id, recall, mrr, ndcg, round(recall - lag(recall) OVER (ORDER BY step), 6) AS recall_change FROM (SELECT *, row_number() OVER (ORDER BY created_at, run_id) AS step FROM (SELECT run_id, created_at, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM {_FACTRUNS} JOIN {_ATS} USING (run_id) GROUP BY 1, 2 ORDER BY created_at DESC, run_id DESC LIMIT 8))",
    "hst_history": f"WITH latest AS (SELECT DISTINCT run_id, created_at FROM {_FACTRUNS} JOIN {_ATS} USING (run_id) ORDER BY created_at DESC, run_id DESC LIMIT 100), each AS (SELECT * FROM {_FACTRUNS} WHERE run_id IN (SELECT run_id FROM latest)) SELECT (SELECT count(*) FROM latest) AS runs, (SELECT run_id FROM latest ORDER BY created_at DESC, run_id DESC LIMIT 1) AS latest, (SELECT strategy FROM each ORDER BY recall DESC, strategy LIMIT 1) AS best_strategy, (SELECT round(avg(recall), 6) FROM each) AS recall, 0.0::DOUBLE AS latency",
    "hst_runs": f"SELECT run_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, 'experiment' AS kind, chars FROM (SELECT run_id, created_at, 2 + sum(length(strategy) + 3) + count(*) - 1 + sum(length(j)) AS chars FROM (SELECT *, '{{\"recall\":' || recall::DOUBLE::VARCHAR || ',\"mrr\":' || mrr::DOUBLE::VARCHAR || ',\"ndcg\":' || ndcg::DOUBLE::VARCHAR || '}}' AS j FROM {_FACTRUNS}) JOIN {_ATS} USING (run_id) GROUP BY 1, 2) ORDER BY created_at DESC, run_id DESC LIMIT 25",
    "hst_comparisons": "SELECT document_id AS run_id, arg_max(lower(status), (arrived_at, lower(status))) AS status, strftime(max(arrived_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM status_log WHERE arrived_at IS NOT NULL GROUP BY 1",
    "src_page_tables": f"SELECT document_id, page_number, i - 1 AS table_no, page_tables[i].page AS page, try_cast(regexp_extract(page_tables[i].shape, '(\\d+)\\D+(\\d+)', 1) AS INT) AS \"rows\", try_cast(regexp_extract(page_tables[i].shape, '(\\d+)\\D+(\\d+)', 2) AS INT) AS columns, page_tables[i].shape AS shape FROM (SELECT *, unnest(generate_series(1, len(page_tables))) AS i FROM {_PAGES})",
    "src_pages": f"SELECT document_id, filename, total_pages, page_number, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words FROM {_PAGES}",
}
