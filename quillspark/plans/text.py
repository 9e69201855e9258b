"""Queries over text functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..sources.tables import table
from . import sql as S


def units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence_units").select("evidence_id", "content")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def joined(c):
    """An array as text."""
    return F.array_join(c, "|")


def _one(source, key: str, text: str, **outs):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = source(spark, folder)
        return df.select(key, *[make(F.col(text)).alias(name) for name, make in outs.items()])

    return query


def _sql(frame: str, key: str, **outs: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in outs.items()) + f" FROM {frame}"


def _parts(source, key: str, text: str, split):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return source(spark, folder).select(key, F.posexplode(split(F.col(text))).alias("position", "part"))

    return query


def _parts_sql(frame: str, key: str, parts: str) -> str:
    return f"SELECT {key}, i - 1 AS position, parts[i] AS part FROM (SELECT {key}, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT {key}, {parts} AS parts FROM {frame}))"


def _hint_sql(x: str) -> str:
    lines = S.kept(f"string_split_regex({x}, '\\n+')")
    first = f"trim({lines}[1], ' :.-')"
    n = S.normalized(first)
    names = ", ".join(S.quoted(k) for k in [*T.KEYWORDS, "general"])
    heading = f"(starts_with({first}, '#') OR (upper({first}) = {first} AND lower({first}) <> {first}) OR regexp_matches({n}, '^(section|article|clause)\\b') OR {n} IN ({names}))"
    return f"CASE WHEN {x} IS NULL OR len({lines}) = 0 OR {n} = '' THEN NULL WHEN length({first}) <= 90 AND {heading} THEN {S.trimmed(f'ltrim({first}, ' + S.quoted('# ') + ')')} WHEN length({first}) <= 60 AND NOT contains({first}, ':') AND len({lines}) > 1 THEN {first} END"


_FLAT = f"trim(regexp_replace(content, '[{S.WS}]+', ' ', 'g'))"
_COURT = S.chunks("content", ".;:")
_WORDS = T.KEYWORDS["governing_law"]
_FIT = f"list_filter({_COURT}, lambda c: {S.contains_any(S.normalized('c'), _WORDS)})"

QUERIES = {
    "txt_normalize": _one(units, "evidence_id", "content", norm=T.normalized),
    "txt_trigram_stats": _one(documents, "doc_id", "text", n_trigrams=lambda c: F.size(T.trigrams(c))),
    "txt_token_stats": _one(documents, "doc_id", "text", n_tokens=lambda c: F.size(T.tokens(c)), n_different=lambda c: F.size(F.array_distinct(T.tokens(c)))),
    "txt_clause_tokens": _one(units, "evidence_id", "content", n_tokens=lambda c: F.size(T.clause_tokens(c)), tokens=lambda c: joined(T.clause_tokens(c))),
    "txt_token_count": _one(documents, "doc_id", "text", n_tokens=T.token_count),
    "txt_paragraphs": _parts(documents, "doc_id", "text", T.paragraphs),
    "txt_sentences": _parts(units, "evidence_id", "content", T.sentences),
    "txt_sentence_with": _one(units, "evidence_id", "content", sentence=lambda c: T.first_sentence_with(c, _WORDS)),
    "txt_section_hint": _one(documents, "doc_id", "text", hint=T.section_hint),
    "txt_category": _one(units, "evidence_id", "content", category=T.category),
    "txt_shorten": _one(units, "evidence_id", "content", short=lambda c: T.shortened(c, 96), query=lambda c: F.left(F.trim(F.regexp_replace(c, rf"[{T.WS}]+", " ")), F.lit(180))),
    "txt_overlap": lambda spark, folder: table(spark, folder, "context_bundles").select("bundle_id", "claim", F.array_join("snippets", " ").alias("snippets")).select("bundle_id", F.size(F.filter(F.array_distinct(T.tokens("claim")), lambda t: F.contains(F.lower("snippets"), t))).alias("hits"), F.size(F.array_distinct(T.tokens("claim"))).alias("terms")),
    "ext_dates": _one(units, "evidence_id", "content", dates=lambda c: joined(X.dates(c))),
    "ext_amounts": _one(units, "evidence_id", "content", amounts=lambda c: joined(X.amounts(c)), raw=lambda c: joined(X.raw_numbers(c))),
    "ext_codes": _one(units, "evidence_id", "content", codes=lambda c: joined(X.codes(c))),
    "ext_fields": lambda spark, folder: documents(spark, folder).select("doc_id", X.fields("text").alias("f")).select("doc_id", *[F.size(f"f.{n}").alias(f"n_{n}") for n in ("dates", "amounts", "reference_codes")]),
    "ext_money": _one(units, "evidence_id", "content", raw=lambda c: joined(X.money(c)["raw"]), normalized=lambda c: joined(X.money(c)["normalized"])),
    "ext_written_dates": _one(units, "evidence_id", "content", normalized=lambda c: joined(X.written_dates(c)["normalized"])),
    "ext_durations": _one(units, "evidence_id", "content", normalized=lambda c: joined(X.durations(c)["normalized"])),
    "ext_references": _one(units, "evidence_id", "content", normalized=lambda c: joined(X.references(c)["normalized"])),
    "ext_facts": lambda spark, folder: X.with_facts(units(spark, folder), "content").select("evidence_id", F.explode("facts").alias("f")).select("evidence_id", "f.*"),
    "ext_facts_selected": lambda spark, folder: X.with_facts(units(spark, folder), "content").withColumn("category", T.category("content")).select("evidence_id", "category", F.size(X.selected(F.col("facts"), F.col("category"))).alias("selected")),
}
def _refs(x: str) -> str:
    """References of a text: words of any script are put between two marks, which stand for its word boundaries."""
    marked = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)', '\x01\\1\x02', 'g')"
    pattern = f"(?i)\x01(?:ref(?:erence)?|référence|version|revision)\x02?[{S.WS}]*[:#-]?[{S.WS}]*\x01?[A-Z0-9](?:[\x01\x02]?[A-Z0-9._/-])*[\x01\x02]"
    return f"list_transform(regexp_extract_all({marked}, {S.quoted(pattern)}), lambda v: {S.trimmed("regexp_replace(v, '[\x01\x02]', '', 'g')")})"


def _firsts(found: str, norm: str) -> str:
    """Of the found values the first of each normal form, as (raw, norm)."""
    pairs = f"list_transform({found}, lambda v: struct_pack(raw := {S.trimmed('v')}, norm := {norm}))"
    return f"list_filter({pairs}, lambda p, i: list_position(list_transform({pairs}, lambda o: o.norm), p.norm) = i)"


def _facts_sql() -> str:
    hit = lambda c: S.contains_any("flat", T.KEYWORDS[c])
    money = f"replace(regexp_replace(lower(v), '[{S.WS}]+', '', 'g'), ',', '.')"
    found = {"amount": _firsts(S.every("t", X.MONEY), money), "date": _firsts(S.every("t", X.DATE), S.normalized("v")), "duration": _firsts(S.every("t", X.DURATION), S.normalized("v")), "reference": _firsts(_refs("t"), S.normalized("v"))}
    fact = lambda kind, raw, norm, category, c: f"struct_pack(field_type := '{kind}', raw_value := {raw}, normalized_value := {norm}, category := {category}, confidence := {c}::DOUBLE)"
    parts = []
    for kind, _, a, b, c in X.VALUES:
        category = f"'{a}'" if a == b else f"CASE WHEN {hit(a)} THEN '{a}' ELSE '{b}' END"
        parts.append(f"list_filter(list_transform({found[kind]}, lambda p: {fact(kind, 'p.raw', 'p.norm', category, c)}), lambda f: f.normalized_value <> '')")
    steps = [f"texts AS (SELECT row_number() OVER () AS rid, evidence_id, content, coalesce(content, '') AS t, {S.normalized("coalesce(content, '')")} AS flat FROM evidence_units)", f"valued AS (SELECT *, list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]})) AS vs FROM texts)"]
    chunks = S.chunks("t", ".;:")
    said = []
    for kind, category, c, alone in X.SENTENCES:
        fit = f"list_filter({chunks}, lambda k: {S.contains_any(S.normalized('k'), T.KEYWORDS[category])})"
        sentence = f"left(CASE WHEN len({fit}) > 0 THEN {fit}[1] WHEN len({chunks}) > 0 THEN {chunks}[1] ELSE {S.trimmed('t')} END, 240)"
        free = f"len(list_filter(vs, lambda f: f.category = '{category}')) = 0" if alone else "true"
        said.append(f"CASE WHEN {hit(category)} AND {free} THEN [{fact(kind, S.trimmed(sentence), S.normalized(sentence), f"'{category}'", c)}] ELSE [] END")
    steps.append("said AS (SELECT *, list_concat(list_concat(vs, " + said[0] + "), list_concat(" + said[1] + ", list_concat(" + said[2] + ", " + said[3] + "))) AS fs FROM valued)")
    first = f"left(CASE WHEN len({chunks}) > 0 THEN {chunks}[1] ELSE {S.trimmed('t')} END, 240)"
    steps.append(f"facts AS (SELECT rid, evidence_id, content, CASE WHEN len(fs) = 0 AND regexp_matches({S.masked('t')}, {S.quoted(X.MODAL)}) THEN [{fact('clause_text', S.trimmed(first), S.normalized(first), "'general'", 0.5)}] ELSE fs END AS facts FROM said)")
    return ", ".join(steps)


_E, _D = "evidence_units", "documents"
ORACLE = {
    "txt_normalize": _sql(_E, "evidence_id", norm=S.normalized("content")),
    "txt_trigram_stats": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(n) < 3 THEN CASE WHEN n = '' THEN 0 ELSE 1 END ELSE len(list_distinct(list_transform(list_zip(c, c[2:], c[3:]), lambda z: z[1] || z[2] || z[3]))) END AS n_trigrams FROM (SELECT *, regexp_extract_all(n, '(?s).') AS c FROM (SELECT doc_id, text, {S.normalized('text')} AS n FROM documents))",
    "txt_token_stats": _sql(_D, "doc_id", n_tokens=f"len({S.every('lower(text)', '[a-z0-9]+')})", n_different=f"len(list_distinct({S.every('lower(text)', '[a-z0-9]+')}))"),
    "txt_clause_tokens": _sql(_E, "evidence_id", n_tokens=f"len({S.pieces('content')})", tokens=S.joined(f"list_transform({S.pieces('content')}, lambda t: trim(lower(t), {S.quoted(T.STRIPPED)}))")),
    "txt_token_count": _sql(_D, "doc_id", n_tokens=f"len({S.pieces('text')})"),
    "txt_paragraphs": _parts_sql(_D, "doc_id", S.paragraphs("text")).replace("FROM documents)", "FROM documents WHERE text IS NOT NULL)"),
    "txt_sentences": _parts_sql(_E, "evidence_id", S.chunks("content", ".!?;:")),
    "txt_sentence_with": _sql(_E, "evidence_id", sentence=f"left(CASE WHEN len({_FIT}) > 0 THEN {_FIT}[1] WHEN len({_COURT}) > 0 THEN {_COURT}[1] ELSE {S.trimmed('content')} END, 240)"),
    "txt_section_hint": _sql(_D, "doc_id", hint=_hint_sql("text")),
    "txt_category": _sql(_E, "evidence_id", category=f"{S.category('content', X.MONEY, X.DATE)}"),
    "txt_shorten": _sql(_E, "evidence_id", short=f"CASE WHEN length({_FLAT}) <= 96 THEN {_FLAT} ELSE rtrim(left({_FLAT}, 95)) || '…' END", query=f"left({_FLAT}, 180)"),
    "txt_overlap": f"SELECT bundle_id, len(list_filter(q, lambda t: contains(lower(s), t))) AS hits, len(q) AS terms FROM (SELECT bundle_id, list_distinct({S.every('lower(claim)', '[a-z0-9]+')}) AS q, array_to_string(snippets, ' ') AS s FROM context_bundles)",
    "ext_dates": _sql(_E, "evidence_id", dates=S.joined(S.distinct_sorted(S.every("content", X.PLAIN_DATE, 1)))),
    "ext_amounts": _sql(_E, "evidence_id", amounts=S.joined(S.amounts("content", X.NUMBER)), raw=f"array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|')").replace("FROM evidence_units", f"FROM (SELECT *, {S.every('content', X.NUMBER, 1)} AS l FROM evidence_units)"),
    "ext_codes": _sql(_E, "evidence_id", codes=S.joined(S.distinct_sorted(f"list_transform({S.every(S.masked('content'), X.CODE)}, lambda v: upper(v))"))),
    "ext_fields": _sql(_D, "doc_id", n_dates=f"len({S.distinct_sorted(S.every('text', X.PLAIN_DATE, 1))})", n_amounts=f"len({S.amounts('text', X.NUMBER)})", n_reference_codes=f"len(list_distinct(list_transform({S.every(S.masked('text'), X.CODE)}, lambda v: upper(v))))"),
    "ext_money": _sql(_E, "evidence_id", raw=S.joined(f"list_transform({S.every('content', X.MONEY)}, lambda v: trim(v))"), normalized=S.joined(f"list_transform({S.every('content', X.MONEY)}, lambda v: replace(regexp_replace(lower(v), '[{S.WS}]+', '', 'g'), ',', '.'))")),
    "ext_written_dates": _sql(_E, "evidence_id", normalized=S.joined(f"list_transform({S.every('content', X.DATE)}, lambda v: {S.normalized('v')})")),
    "ext_durations": _sql(_E, "evidence_id", normalized=S.joined(f"list_transform({S.every('content', X.DURATION)}, lambda v: {S.normalized('v')})")),
    "ext_references": _sql(_E, "evidence_id", normalized=S.joined(f"list_transform({_refs('content')}, lambda v: {S.normalized('v')})")),
    "ext_facts": f"WITH {_facts_sql()} SELECT evidence_id, f.field_type, f.raw_value, f.normalized_value, f.category, f.confidence FROM (SELECT evidence_id, unnest(facts) AS f FROM facts)",
    "ext_facts_selected": f"WITH {_facts_sql()} SELECT evidence_id, category, CASE WHEN category = 'general' OR len(own) = 0 THEN len(facts) ELSE len(own) END AS selected FROM (SELECT *, list_filter(facts, lambda f: f.category = category) AS own FROM (SELECT *, {S.category('content', X.MONEY, X.DATE)} AS category FROM facts))",
}
