"""Conflicts between claims and the evidence for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from .diff import with_likeness

# Words that negate, weights of conflicts, and what to do by severity.
NEGATIONS = ("not", "no", "never", "none", "without", "aucun", "pas")
WEIGHTS = {"amount_conflict": 4, "date_conflict": 3, "reference_mismatch": 2, "clause_conflict": 2}
HINTS = {"amount_conflict": 4, "date_conflict": 3, "table_conflict": 3, "reference_mismatch": 2, "clause_conflict": 2}
ADVICE = {"critical": "escalate", "high": "review", "medium": "check", "low": "none"}


def apart(a: Column, b: Column) -> Column:
    """Whether two sets of values both have some and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def negations(c: Column) -> Column:
    return F.array_intersect(T.clause_tokens(c), F.array(*[F.lit(n) for n in NEGATIONS]))


def _of(table: dict, kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[kind], F.lit(1))


def heaviest(kinds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(kinds, lambda k: _of(HINTS, k))), F.lit(0))


def weight(kinds: Column) -> Column:
    return F.aggregate(kinds, F.lit(0), lambda a, k: a + _of(WEIGHTS, k))


def severity(kinds: Column) -> Column:
    """low to critical from an array of kinds of conflicts: by the heaviest and by their sum."""
    return graded(heaviest(kinds), weight(kinds))


def graded(heaviest: Column, total: Column) -> Column:
    return F.when((heaviest >= 4) | (total >= 8), "critical").when((heaviest >= 3) | (total >= 5), "high").when((heaviest >= 2) | (total >= 2), "medium").otherwise("low")


def advice(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in ADVICE.items() for x in p])[level]


def packed(claim: Column, snippets: Column, most: Column) -> Column:
    """Snippets that fit beside a claim in ``most`` characters, five more for each; the first that doesn't is cut and is the last."""
    clean = F.filter(F.transform(snippets, T.trimmed), lambda s: s.isNotNull() & (s != ""))
    start = F.struct((most - F.char_length(claim)).alias("room"), F.array().cast("array<string>").alias("kept"))

    def step(a, s):
        need = F.char_length(s) + 5
        cut = F.concat(F.left(s, F.greatest(F.lit(0), a["room"] - 3)), F.lit("..."))
        return F.when(a["room"] <= 0, a).when(need <= a["room"], F.struct((a["room"] - need).alias("room"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(F.struct(F.lit(0).alias("room"), F.concat(a["kept"], F.array(cut)).alias("kept")))

    return F.aggregate(clean, start, step)["kept"]


def context(claim: Column, kept: Column, most: Column) -> Column:
    """Claim and snippets as one text of at most ``most`` characters, longer ones with dots behind."""
    text = T.trimmed(F.array_join(F.concat(F.array(claim), kept), "\n---\n"))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, most)), F.lit("...")))


def conflicts(df: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """``df`` with the values found on both sides and ``conflicts``: kinds of date, amount, reference and number conflicts."""
    out = df
    for side, text in (("claim", claim), ("evidence", evidence)):
        out = out.withColumns({f"{side}_dates": X.dates(text), f"{side}_amounts": X.amounts(text), f"{side}_codes": X.codes(text), f"{side}_numbers": X.raw_numbers(text)})
    kinds = F.array(
        F.when(apart(F.col("claim_dates"), F.col("evidence_dates")), F.lit("date_conflict")),
        F.when(apart(F.col("claim_amounts"), F.col("evidence_amounts")), F.lit("amount_conflict")),
        F.when(apart(F.col("claim_codes"), F.col("evidence_codes")), F.lit("reference_mismatch")),
        F.when(apart(F.col("claim_numbers"), F.col("evidence_numbers")), F.lit("table_conflict")),
    )
    return out.withColumn("conflicts", F.filter(kinds, lambda k: k.isNotNull()))


def clause_conflicts(df: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """``df`` with ``clause_similarity`` and ``clause_conflict``: alike texts of which one negates otherwise.

    Texts that negate alike can be no conflict, so only the others are aligned; the similarity of those is null.
    """
    differ = F.size(F.array_except(negations(F.col(claim)), negations(F.col(evidence)))) + F.size(F.array_except(negations(F.col(evidence)), negations(F.col(claim)))) > 0
    sides = df.withColumns({"_a": F.when(differ, F.lower(claim)), "_b": F.when(differ, F.lower(evidence))})
    like = with_likeness(sides, "_a", "_b", junk=True, out="clause_similarity").drop("_a", "_b")
    return like.withColumn("clause_conflict", F.coalesce(F.col("clause_similarity") > 0.35, F.lit(False)))


def evidence(claims: DataFrame) -> DataFrame:
    """``claims(claim, snippets, ...)`` with the parts of their evidence: the first eight snippets as one text, the first as the section. Null claims are left out."""
    rows = claims.where("claim is not null").withColumn("parts", F.filter(F.coalesce("snippets", F.array().cast("array<string>")), lambda s: s.isNotNull() & (T.trimmed(s) != "")))
    return rows.withColumn("evidence", F.array_join(F.slice("parts", 1, 8), "\n")).withColumn("section", F.coalesce(F.get("parts", F.lit(0)), F.lit("")))


def judged(rows: DataFrame) -> DataFrame:
    """Severity, advice, verdict, context and its compression for rows with ``conflicts``, ``parts`` and ``max_chars``."""
    kept = packed(F.col("claim"), F.slice("parts", 1, 3), F.col("max_chars"))
    full = rows.withColumn("severity", severity(F.col("conflicts"))).withColumn("context", context(F.col("claim"), kept, F.col("max_chars")))
    raw = F.char_length(F.concat(F.col("claim"), F.array_join(kept, "")))
    full = full.withColumn("compression_ratio", F.round(T.compression_ratio(raw, F.char_length("context")), 4)).withColumn("advice", advice(F.col("severity")))
    return full.withColumn("verdict", F.when(F.size("conflicts") > 0, "inconsistent").otherwise("consistent")).withColumn("conflict_types", F.array_join("conflicts", ", "))


def detect(claims: DataFrame, alike: bool = True) -> DataFrame:
    """All checks on claims(claim_id, document_id, claim, snippets, max_chars): conflicts, severity, context and its compression.

    Null claims are left out. Without ``alike`` the checks that align texts are left out: the clause conflict and whether the section changed.
    """
    rows = conflicts(evidence(claims))
    if alike:
        rows = clause_conflicts(rows)
        rows = rows.withColumn("conflicts", F.when(F.col("clause_conflict"), F.concat("conflicts", F.array(F.lit("clause_conflict")))).otherwise(F.col("conflicts")))
        rows = with_likeness(rows.withColumns({"_a": F.lower("claim"), "_b": F.lower("section")}), "_a", "_b", junk=True, out="_like").drop("_a", "_b")
        rows = rows.withColumn("section_changed", F.col("_like") < 0.75).drop("_like")
    return judged(rows).drop("parts")


def escalated(results: DataFrame) -> DataFrame:
    """The results a judge is asked about, those of high and critical severity, with what they fall back to if it fails: the local verdict, unsure."""
    rows = results.where(F.col("severity").isin("high", "critical"))
    return rows.withColumn("fallback", F.struct(F.col("verdict").alias("verdict"), F.lit("local_rules").alias("decided_by"), F.lit(True).alias("needs_review")))


def by_document(results: DataFrame) -> DataFrame:
    """Per document: claims, conflicts, severity over all of them, and mean compression."""
    per = results.select("document_id", F.size("conflicts").alias("n"), heaviest(F.col("conflicts")).alias("top"), weight(F.col("conflicts")).alias("sum"), "compression_ratio")
    g = per.groupBy("document_id").agg(F.count("*").alias("claims"), F.sum("n").alias("conflict_count"), F.max("top").alias("top"), F.sum("sum").alias("sum"), F.round(F.avg("compression_ratio"), 4).alias("mean_compression"))
    return g.withColumn("severity", graded(F.col("top"), F.col("sum"))).withColumn("judge_required", F.col("severity").isin("high", "critical")).drop("top", "sum")
