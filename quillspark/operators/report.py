"""What is shown of changes, claims and runs: summaries, groups, issues, highlights, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .compare import _by, page_of, rank_of
from .diff import focus

# Explanations of changes, and what is said where there is none.
EXPLAINED = {
    "date_change": "La date passe de '%s' à '%s', ce qui modifie la temporalité de la clause.",
    "numeric_change": "La valeur passe de '%s' à '%s', ce qui peut modifier la portée financière ou quantitative de l'obligation.",
    "reference_change": "La référence passe de '%s' à '%s', ce qui peut renvoyer à une base juridique ou documentaire différente.",
}
MEANING = " Cela peut changer le sens ou la portée de la clause."
CHANGED = "La formulation de cette clause a changé, ce qui peut modifier son interprétation."
NO_CHANGE = "Aucun changement significatif détecté."


def explanation() -> Column:
    """What a change means: by its kind and values, else by its steps, else its summary."""
    value = lambda side: T.shortened(F.coalesce(F.nullif(f"{side}_normalized", F.lit("")), f"{side}_raw"), 72)
    left, right = F.coalesce(value("left"), F.lit("")), F.coalesce(value("right"), F.lit(""))
    sharp = F.when((left != "") & (right != ""), _by(EXPLAINED, F.col("subtype"), lambda form: F.format_string(form, left, right)))
    steps = focus(F.col("ops"))
    return F.coalesce(sharp, F.when(steps != "", F.concat(steps, F.lit(MEANING))), F.nullif(T.trimmed("summary"), F.lit("")), F.lit(CHANGED))


def summaries(changes: DataFrame, pairs: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(pair_id, summary): the ``top`` changes of each pair by importance and page, a line each; with ``pairs`` those without changes too."""
    order = Window.partitionBy("pair_id").orderBy(-rank_of(F.col("importance")), page_of(), "number")
    some = changes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    lines = some.select("pair_id", "_n", F.concat(F.lit("- "), "title", F.lit(": "), explanation()).alias("line"))
    out = lines.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("summary"))
    if pairs is None:
        return out
    return pairs.select("pair_id").distinct().join(out, "pair_id", "left").withColumn("summary", F.coalesce("summary", F.lit(NO_CHANGE)))


def groups(changes: DataFrame) -> DataFrame:
    """(pair_id, subtype, changes, place): how many changes of each kind, the most frequent first."""
    n = changes.groupBy("pair_id", "subtype").agg(F.count("*").alias("changes"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("changes"), "subtype")))


def issues(changes: DataFrame) -> DataFrame:
    """Changes as issues, with how their sides are aligned."""
    sure = F.col("confidence")
    delta = F.abs(F.coalesce("left_page", F.lit(0)) - F.coalesce("right_page", F.lit(0)))
    return changes.select("pair_id", F.concat(F.lit("issue-"), F.col("number").cast("string")).alias("issue_id"), F.col("title").alias("claim"), F.col("field_type").alias("category"), F.lit("inconsistent").alias("verdict"), F.col("importance").alias("severity"), sure.alias("confidence"), "summary", F.when(sure >= 0.5, "high").otherwise("medium").alias("evidence_quality"), delta.alias("position_delta"))


def important_tokens(changes: DataFrame) -> DataFrame:
    """(pair_id, token): titles, kinds and types of the important changes, in lower case, each once."""
    some = changes.where(F.lower("importance").isin("high", "critical"))
    token = F.explode(F.array(F.lower("title"), F.lower("subtype"), F.lower("field_type"))).alias("token")
    return some.select("pair_id", token).where("token <> ''").distinct()


def highlights(elements: DataFrame, page: Column | int) -> DataFrame:
    """Boxes to mark on a page, in percent of it, of elements(document_id, page, element, box); those without a box are left out."""
    percent = lambda v: F.concat(F.round(v * 100, 4).cast("string"), F.lit("%"))
    b = F.col("box")
    rows = elements.where((F.col("page") == page) & b.isNotNull())
    size = lambda a, z: F.greatest(F.lit(0.0), z - a)
    return rows.select("document_id", "page", "element", percent(b["x1"]).alias("left"), percent(b["y1"]).alias("top"), percent(size(b["x1"], b["x2"])).alias("width"), percent(size(b["y1"], b["y2"])).alias("height"))


def best_blocks(units: DataFrame) -> DataFrame:
    """(document_id, category, evidence_id, hits): of each keyword group the unit with most of its keywords, the first of equals; none without any."""
    low = F.lower("content")
    scored = F.explode(F.array(*[F.struct(F.lit(name).alias("category"), F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))).alias("hits")) for name, words in T.KEYWORDS.items()])).alias("g")
    rows = units.where("content is not null").select("document_id", "evidence_id", scored).select("document_id", "evidence_id", "g.*").where("hits > 0")
    best = rows.groupBy("document_id", "category").agg(F.min(F.struct(-F.col("hits"), F.col("evidence_id"))).alias("b"))
    return best.select("document_id", "category", F.col("b.evidence_id").alias("evidence_id"), (-F.col("b.col1")).alias("hits"))


def salvaged(answer: Column, schema: str) -> Column:
    """The JSON of an answer, also where it stands within other text; null where there is none."""
    whole = F.from_json(F.when(F.startswith(T.trimmed(answer), F.lit("{")), answer), schema)
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.from_json(F.when(inner != "", inner), schema))


def verdict_of(answer: Column) -> Column:
    """(verdict, severity, confidence, summary) of an answer; insufficient evidence, with the answer as summary, where it holds no JSON."""
    schema = "verdict string, severity string, confidence double, summary string"
    # What stands for an answer that can't be read.
    default = F.struct(F.lit("insufficient_evidence").alias("verdict"), F.lit("medium").alias("severity"), F.lit(None).cast("double").alias("confidence"), F.left(T.trimmed(F.coalesce(answer, F.lit(""))), F.lit(500)).alias("summary"))
    return F.coalesce(salvaged(answer, schema), default)


def explanation_prompt(result: str | Column) -> Column:
    """What is asked for to explain one result."""
    return F.concat(F.lit("Explain this result in at most five points: kinds of conflicts, severity, what to do.\n\n"), F.to_json(T.col(result)))


def summary_prompt(results: str | Column) -> Column:
    """What is asked for to sum up several results."""
    return F.concat(F.lit("Sum up these results for a reader with little time.\n\n"), F.to_json(T.col(results)))


def comparison_prompt(claim: str, category: str, hint: str | Column, blocks: str | Column) -> Column:
    """What is asked for to compare evidence on a claim; ``blocks`` is an array of texts, of which two are shown."""
    shown = F.array_join(F.slice(T.col(blocks), 1, 2), "\n")
    return F.concat_ws("\n", F.lit("Compare the evidence on the claim. Answer with JSON: verdict, severity, confidence, summary."), F.concat(F.lit("Claim: "), F.col(claim)), F.concat(F.lit("Category: "), F.col(category)), F.concat(F.lit("Local decision: "), F.to_json(T.col(hint))), F.lit("Pairs:"), F.when(F.size(T.col(blocks)) > 0, shown).otherwise("none"))


def grounded_prompt(question: str, evidence: str | Column) -> Column:
    """What is asked for to answer from evidence only: an array of (id, text)."""
    lines = F.transform(T.col(evidence), lambda e: F.concat(F.lit("["), e["id"], F.lit("] "), e["text"]))
    return F.concat_ws("\n", F.lit("Answer from the evidence only and name the ids you used."), F.concat(F.lit("Question: "), F.col(question)), F.lit("Evidence:"), F.array_join(lines, "\n"))
