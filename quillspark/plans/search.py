"""Queries over search: claims against all evidence, every claim or those whose bundle id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import search as R
from ..operators.vectors import VectorIndex
from ..session import materialize, scratch
from ..sources.tables import table
from . import sql as S

#: Expressions that are searched for; one is invalid, one has letters to be told from others.
PATTERNS = {"r1": r"REF-[A-Z0-9]{5,7}", "r2": r"(clause|article) [0-9]+[.]1[0-9]", "r3": "/penalty cap/i", "r4": r"tolerance (DOC|REV)", "r5": "budget(", "r6": r"shall not exceed 9[0-9]{3} units"}


def corpus(spark, folder):
    units = I.upserted(table(spark, folder, "evidence_units"))
    return units.select(F.col("evidence_id").alias("id"), F.col("content").alias("text"), "document_id")


def claims(spark, folder):
    some = table(spark, folder, "context_bundles").where("bundle_id % 100 = 0 and claim is not null").select("bundle_id", "document_id", "claim").distinct()
    return some.select(F.col("bundle_id").cast("string").alias("query_id"), F.col("claim").alias("query"), "document_id")


def every_claim(spark, folder):
    some = table(spark, folder, "context_bundles").where("claim is not null").select("bundle_id", "document_id", "claim").distinct()
    return some.select(F.col("bundle_id").cast("string").alias("query_id"), F.col("claim").alias("query"), "document_id")


def _keyword(how, k=10):
    def query(spark, folder):
        hits = R.keyword(corpus(spark, folder), claims(spark, folder).select("query_id", "query"), k, how)
        return hits.select("query_id", "id", "rank", "token_hits", "tokens", F.round("score", 6).alias("score"))

    return query


def _plans(spark):
    return R.planned(spark.createDataFrame(list(PATTERNS.items()), "query_id string, query string"))


def _regexes(scan: bool, indexed: bool):
    def query(spark, folder):
        rows = corpus(spark, folder).select("id", "text")
        index = R.trigram_index(rows) if indexed else None
        hits = R.best(R.regexes(rows, _plans(spark), index, scan), 10)
        return hits.select("query_id", "id", "match_chars", "score")

    return query


def prune(spark, folder):
    """How many rows the index leaves to verify, and how many of them match."""
    rows = corpus(spark, folder).select("id", "text").where("text is not null and text <> ''")
    plans = materialize(_plans(spark).where("valid and alternatives is not null"), "plans")
    asked = plans.select("query_id", F.posexplode("alternatives").alias("alternative", "set")).select("query_id", "alternative", F.size("set").alias("n"), F.explode("set").alias("trigram"))
    met = R.trigram_index(rows).join(asked, "trigram").groupBy("query_id", "alternative", "n", "id").agg(F.countDistinct("trigram").alias("have")).where("have = n")
    left = met.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("candidates"))
    match = R.regexes(rows, plans).groupBy("query_id").agg(F.countDistinct("id").alias("matches"))
    total = rows.agg(F.countDistinct("id").alias("rows"))
    named = plans.select("query_id").join(left, "query_id", "left").join(match, "query_id", "left")
    # the total is one row
    counted = named.join(F.broadcast(total.withColumn("_one", F.lit(1))), F.col("_one") == 1)
    return counted.select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("matches", F.lit(0)).alias("matches"), "rows")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label", "vec_id")


def fused(spark, folder):
    """Two rankings of the same texts, by shared tokens and by the whole keyword score, as one; the texts are met once."""
    q = every_claim(spark, folder).select("query_id", "query")
    ways = {"baseline": 12, "lexical": 10}
    counts = materialize(R.topped(materialize(corpus(spark, folder), "corpus"), q, ways), "counts")
    a, b = (R.best(R.scored(counts.where(F.col("how") == how), how), k).select("query_id", "id", "score", "rank") for how, k in ways.items())
    return R.fuse(a, b, 10).select("query_id", "id", "rank", F.array_join("sources", ",").alias("sources"), "semantic_rank", "lexical_rank", "score")


def grounded(spark, folder):
    """The best evidence of each claim's own document, with its text."""
    rows = materialize(corpus(spark, folder), "corpus")
    hits = R.grounded(rows, claims(spark, folder), 5)
    return hits.join(rows.select("id", "document_id", "text"), ["id", "document_id"]).select("query_id", "id", "document_id", "rank", "score", "mode", F.md5("text").alias("text"))


def overfetched(spark, folder):
    """Ranking first, five times as many, then the filter: rows of the documents that others crowd out are lost."""
    q, rows = claims(spark, folder), materialize(corpus(spark, folder), "corpus")
    hits = R.keyword(rows, q.select("query_id", "query"), 50, "lexical").select("query_id", "id", "score")
    kept = hits.join(rows.select("id", "document_id"), "id").join(q.select("query_id", "document_id"), ["query_id", "document_id"])
    return R.best(kept.select("query_id", "id", "score"), 10).select("query_id", "id", "rank", "score")


def page_filtered(spark, folder):
    """Keyword search among the evidence of some pages: a condition with named values, applied before ranking."""
    units = I.upserted(table(spark, folder, "evidence_units")).select(F.col("evidence_id").alias("id"), F.col("content").alias("text"), "page_number")
    rows = R.filtered(units, "page_number BETWEEN :low AND :high", low=2, high=3)
    return R.keyword(rows, claims(spark, folder).select("query_id", "query"), 5, "baseline").select("query_id", "id", "rank", "score")


def dispatched(spark, folder):
    """Claims and expressions in one table of queries, by the lexical strategy, with how many candidates each had."""
    q = every_claim(spark, folder).select("query_id", "query").unionByName(spark.createDataFrame(list(PATTERNS.items()), "query_id string, query string"))
    return R.run(spark, materialize(corpus(spark, folder), "corpus").select("id", "text"), q, "lexical", 10).select("query_id", "id", "rank", "score", "candidate_count")


def index_recall(spark, folder):
    """Vectors with ids divisible by 100 asked of a saved index of all vectors: whether it finds nine tenths of the exact neighbours."""
    every = vectors(spark, folder).select("id", "vector", "label")
    asked = vectors(spark, folder).where("vec_id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    index = VectorIndex(spark, scratch(spark, "vectors"))
    index.create(every)
    index.add(every)
    found = index.search(asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    exact = R.nearest(every.select("id", "vector"), asked, 10).select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


QUERIES = {
    "search_index_recall": index_recall,
    "search_baseline_topk": _keyword("baseline"),
    "search_lexical_topk": _keyword("lexical"),
    "search_rg_topk": _keyword("rg"),
    "search_regex_indexed": _regexes(False, True),
    "search_regex_scan": _regexes(True, False),
    "search_prune": prune,
    "search_fused": fused,
    "search_grounded": grounded,
    "search_overfetched": overfetched,
    "search_filtered": page_filtered,
    "search_dispatched": dispatched,
    "search_hybrid": lambda s, f: R.run(s, materialize(corpus(s, f), "corpus").select("id", "text"), every_claim(s, f).select("query_id", "query"), "hybrid"),
    "search_semantic": lambda s, f: R.run(s, corpus(s, f), claims(s, f).select("query_id", "query"), "semantic"),
    "search_nearest": lambda s, f: R.nearest(vectors(s, f), vectors(s, f).where("vec_id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10),
    "search_late_interaction": lambda s, f: R.late_interaction(vectors(s, f).select(F.col("label").alias("id"), "vector"), vectors(s, f).where("vec_id % 100 = 0").select(F.col("label").alias("query_id"), "vector"), 10),
    "index_trigrams": lambda s, f: R.trigram_index(corpus(s, f)).groupBy("trigram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "trigram").limit(50),
    "index_tokens": lambda s, f: R.token_index(corpus(s, f)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "token").limit(50),
}

_CORPUS = "corpus AS (SELECT evidence_id AS id, content AS text, document_id FROM evidence_units QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at DESC NULLS LAST, content DESC NULLS LAST) = 1)"
_CLAIMS = "claims AS (SELECT DISTINCT CAST(bundle_id AS VARCHAR) AS query_id, claim AS query, document_id FROM context_bundles WHERE bundle_id % 100 = 0 AND claim IS NOT NULL)"

_EVERY_CLAIM = _CLAIMS.replace("bundle_id % 100 = 0 AND ", "")


def _tri(c: str) -> str:
    return f"list_distinct(list_transform(list_zip({c}, {c}[2:], {c}[3:]), lambda z: z[1] || z[2] || z[3]))"


_SIDES = f"""docs AS (SELECT id, document_id, n, {_tri("regexp_extract_all(n, '(?s).')")} AS tri, list_distinct(regexp_extract_all(n, '[a-z0-9]+')) AS tok FROM (SELECT id, document_id, {S.normalized('text')} AS n FROM corpus WHERE text IS NOT NULL AND text <> '')),
asked AS (SELECT query_id, document_id, n, {_tri("regexp_extract_all(n, '(?s).')")} AS tri, regexp_extract_all(n, '[a-z0-9]+') AS tok FROM (SELECT *, {S.normalized('query')} AS n FROM claims) WHERE n <> '')"""


def _scored(how: str, where: str = "") -> str:
    tokens = "len(list_filter(q.tok, lambda t: list_contains(d.tok, t)))"
    total = "len(q.tok)"
    if how == "lexical":
        score, keep = "0.55::DOUBLE * (h.tri / len(q.tri)::DOUBLE) + 0.35::DOUBLE * (h.tok / len(q.tok)::DOUBLE) + 0.10::DOUBLE * h.phrase", "(h.tri = len(q.tri) OR h.tok > 0)"
    elif how == "baseline":
        tokens, total = "len(list_intersect(q.tok, d.tok))", "len(list_distinct(q.tok))"
        score, keep = "0.8::DOUBLE * (h.tok / len(list_distinct(q.tok))::DOUBLE) + 0.2::DOUBLE * h.phrase", "(h.tok > 0 OR h.phrase > 0)"
    else:
        tokens = "len(list_filter(q.tok, lambda t: contains(d.n, t)))"
        score, keep = "h.tok / len(q.tok)::DOUBLE", "h.tok > 0"
    return f"SELECT q.query_id, d.id, d.document_id, q.document_id AS own, h.tok AS token_hits, {total} AS tokens, round({score}, 6) AS score FROM asked q, docs d, LATERAL (SELECT len(list_intersect(q.tri, d.tri)) AS tri, {tokens} AS tok, CAST(contains(d.n, q.n) AS INT) AS phrase) h WHERE {keep} {where}"


def _top(rows: str, k: int, name: str = "rank") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS {name} FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k}"


def _keyword_sql(how: str) -> str:
    return f"WITH {_CORPUS}, {_CLAIMS}, {_SIDES} SELECT query_id, id, rank, token_hits, tokens, score FROM ({_top(_scored(how), 10)})"


def _regex_hits(scan: bool) -> list[str]:
    parts = []
    for name, pattern in PATTERNS.items():
        plan = R.planner.plan(pattern)
        if not plan.valid:
            continue
        p = S.quoted(("(?i)" if plan.flags else "") + plan.pattern)
        n = f"list_sum(list_transform(regexp_extract_all(text, {p}), lambda m: length(m)))" if scan else f"length(regexp_extract(text, {p}))"
        a, b = ("0.5", "0.5") if scan else ("0.7", "0.3")
        parts.append(f"(SELECT '{name}' AS query_id, id, {n} AS match_chars, round(least(1.0, {a}::DOUBLE + {b}::DOUBLE * ({n} / length(text)::DOUBLE)), 6) AS score FROM corpus WHERE regexp_matches(text, {p}))")
    return parts


def _regex_sql(scan: bool) -> str:
    return f"WITH {_CORPUS} " + " UNION ALL ".join(part[:-1] + " ORDER BY score DESC, id LIMIT 10)" for part in _regex_hits(scan))


def _prune_sql() -> str:
    """What the sound plan asks of a text, written out: all sequences of one alternative."""
    parts = []
    for name, pattern in PATTERNS.items():
        plan = R.planner.plan(pattern)
        if plan.valid and plan.alternatives is not None:
            asks = " OR ".join("(" + " AND ".join(f"contains(n, {S.quoted(t)})" for t in sorted(a)) + ")" for a in plan.alternatives)
            p = S.quoted(("(?i)" if plan.flags else "") + plan.pattern)
            parts.append(f"SELECT '{name}' AS query_id, count_if({asks}) AS candidates, count_if(regexp_matches(text, {p})) AS matches, count(*) AS rows FROM (SELECT text, {S.normalized('text')} AS n FROM corpus WHERE text <> '')")
    return f"WITH {_CORPUS} " + " UNION ALL ".join(parts)


def _dispatched_sql() -> str:
    bad = [n for n, p in PATTERNS.items() if not R.planner.plan(p).valid]
    asked = _EVERY_CLAIM.replace("claims AS (", "claims AS (SELECT * FROM (") + " WHERE NOT regexp_matches(query, '[.^$*+?{}\\[\\]\\\\|()]')"
    asked += "".join(f" UNION ALL SELECT '{n}', {S.quoted(PATTERNS[n])}, NULL" for n in bad) + ")"
    words = f"SELECT query_id, id, score FROM ({_scored('lexical')})"
    # a claim with a full stop is an expression: any character stands for it
    dotted = "SELECT c.query_id, t.id, round(least(1.0, 0.7::DOUBLE + 0.3::DOUBLE * (length(regexp_extract(t.text, c.query)) / length(t.text)::DOUBLE)), 6) AS score FROM every c JOIN corpus t ON regexp_matches(t.text, c.query) WHERE regexp_matches(c.query, '[.^$*+?{}\\[\\]\\\\|()]')"
    found = " UNION ALL ".join(f"SELECT query_id, id, score FROM {part}" for part in _regex_hits(False))
    every = _EVERY_CLAIM.replace("claims AS", "every AS")
    return f"WITH {_CORPUS}, {every}, {asked}, {_SIDES}, hits AS ({words} UNION ALL {dotted} UNION ALL {found}), ranked AS ({_top('SELECT * FROM hits', 10)}) SELECT query_id, id, rank, score, count(*) OVER (PARTITION BY query_id) AS candidate_count FROM ranked"


def _side(name: str, source: str) -> str:
    return f"{name} AS (SELECT query_id, id, score, rank, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM ({source}) WINDOW w AS (PARTITION BY query_id))"


def _fused_sql() -> str:
    part = lambda s, w: f"coalesce((0.65::DOUBLE * {s}.norm + 0.35::DOUBLE * (1.0::DOUBLE / (60 + {s}.rank))) * {w}::DOUBLE, 0.0)"
    return f"""WITH {_CORPUS}, {_EVERY_CLAIM}, {_SIDES}, {_side('a', _top(_scored('baseline'), 12))}, {_side('b', _top(_scored('lexical'), 10))}
SELECT query_id, id, rank, sources, semantic_rank, lexical_rank, score FROM ({_top(f'''
SELECT query_id, id, a.rank AS semantic_rank, b.rank AS lexical_rank, CASE WHEN a.rank IS NULL THEN 'lexical' WHEN b.rank IS NULL THEN 'semantic' ELSE 'lexical,semantic' END AS sources,
 round({part('a', '0.55')} + {part('b', '0.45')} + CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 0.08::DOUBLE WHEN a.rank IS NULL AND b.rank <= 5 THEN 0.03::DOUBLE ELSE 0.0 END, 6) AS score
FROM a FULL OUTER JOIN b USING (query_id, id)''', 10)})"""


ORACLE = {
    "search_index_recall": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "search_baseline_topk": _keyword_sql("baseline"),
    "search_lexical_topk": _keyword_sql("lexical"),
    "search_rg_topk": _keyword_sql("rg"),
    "search_regex_indexed": _regex_sql(False),
    "search_regex_scan": _regex_sql(True),
    "search_fused": _fused_sql(),
    "search_grounded": f"WITH {_CORPUS}, {_CLAIMS}, {_SIDES} SELECT t.query_id, t.id, t.document_id, t.rank, t.score, 'index' AS mode, md5(c.text) AS text FROM ({_top(_scored('lexical', 'AND d.document_id = q.document_id'), 5)}) t JOIN corpus c USING (id)",
    "search_filtered": f"WITH {_CORPUS.replace('document_id FROM', 'document_id, page_number FROM').replace('corpus AS', 'whole AS')}, corpus AS (SELECT * FROM whole WHERE page_number BETWEEN 2 AND 3), {_CLAIMS}, {_SIDES} SELECT query_id, id, rank, score FROM ({_top(_scored('baseline'), 5)})",
    "search_prune": _prune_sql(),
    "search_dispatched": _dispatched_sql(),
    "search_overfetched": f"WITH {_CORPUS}, {_CLAIMS}, {_SIDES} SELECT query_id, id, rank, score FROM ({_top("SELECT query_id, id, score FROM (" + _top(_scored("lexical"), 50) + ") WHERE document_id = own", 10)})",
    "search_nearest": "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
    "search_late_interaction": "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(best), 4) AS score FROM (SELECT CAST(q.label AS VARCHAR) AS query_id, q.vec_id, CAST(v.label AS VARCHAR) AS id, max(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS best FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 GROUP BY ALL) GROUP BY 1, 2)) WHERE rank <= 10",
    "index_trigrams": f"WITH {_CORPUS} SELECT t AS trigram, count(*) AS df FROM (SELECT unnest({_tri('c')}) AS t FROM (SELECT regexp_extract_all({S.normalized('text')}, '(?s).') AS c FROM corpus)) WHERE t IS NOT NULL GROUP BY 1 ORDER BY df DESC, trigram LIMIT 50",
    "index_tokens": f"WITH {_CORPUS} SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM corpus) GROUP BY 1 ORDER BY cf DESC, token LIMIT 50",
}
