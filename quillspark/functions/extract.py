"""Dates, amounts, references and durations in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import KEYWORDS, SPACE, col, contains_any, first_sentence_with, normalized, spaced, trimmed

# Patterns of dates, amounts and references in evidence.
PLAIN_DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
NUMBER = r"(?i)(?:USD|EUR|MAD|€|\$)?\s*(\d{1,3}(?:[ ,._]\d{3})*(?:[.,]\d{2})?|\d+(?:[.,]\d{2})?)\s*(?:USD|EUR|MAD|€|\$)?"
CODE = r"(?i)\b(?:REF|DOC|REV|ID)[-_:/]?[A-Z0-9-]{2,}\b"
# Patterns of facts that documents are compared by.
MONEY = r"(?i)\b\d[\d\s.,]*(?:€|eur|usd|\$|mad)\b"
DATE = r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2}|\d{1,2}\s+(?:janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre|january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4})\b"
DURATION = r"(?i)\b\d{1,3}\s+(?:day|days|jour|jours|month|months|mois|year|years|an|ans)\b"
REFERENCE = r"(?i)\b(?:ref(?:erence)?|référence|version|revision)\s*[:#-]?\s*[A-Z0-9][A-Z0-9._/-]*\b"
MODAL = r"(?i)\b(?:shall|must|will|may not|cannot|doit|devra|ne peut pas)\b"


def _all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(spaced(pattern).replace("(?i)", "(?iu)")), group)


def _bounded(c: str | Column) -> Column:
    """The text with invisible characters and combining marks made ones that end a word, as no match may hold one."""
    return F.regexp_replace(col(c), r"[\p{Cf}\p{M}]", "\x01")


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def dates(c: str | Column) -> Column:
    """The different dates written in digits, sorted."""
    return _set(_all(c, PLAIN_DATE, 1))


def decimal_text(number: Column) -> Column:
    """A found number as decimal text: blanks and underscores dropped, the last of , and . the decimal sign, no leading zeros.

    Null if it is no decimal number then.
    """
    x = F.regexp_replace(number, "[ _]", "")
    both = F.contains(x, F.lit(",")) & F.contains(x, F.lit("."))
    comma_last = F.locate(",", F.reverse(x)) < F.locate(".", F.reverse(x))
    x = F.when(both & comma_last, F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")).when(both, F.regexp_replace(x, ",", "")).otherwise(F.regexp_replace(x, ",", "."))
    return F.when(x.rlike(r"^\d+(\.\d+)?$"), F.regexp_replace(x, r"^0+(?=\d)", ""))


def amounts(c: str | Column) -> Column:
    """The different numbers as decimal text, sorted; those that are no decimal numbers are left out."""
    return _set(F.filter(F.transform(_all(c, NUMBER, 1), decimal_text), lambda x: x.isNotNull()))


def raw_numbers(c: str | Column) -> Column:
    """The different numbers as they are written, in order."""
    return F.array_distinct(_all(c, NUMBER, 1))


def codes(c: str | Column) -> Column:
    """The different reference codes in upper case, sorted; the Kelvin sign and the long s count as k and s."""
    return _set(F.transform(_all(_bounded(c), CODE.replace("A-Z0-9-", "A-Z0-9\u212a\u017f-")), F.upper))


def fields(c: str | Column) -> Column:
    """Dates, amounts and reference codes of a text in one struct."""
    return F.struct(dates(c).alias("dates"), amounts(c).alias("amounts"), codes(c).alias("reference_codes"))


def money(c: str | Column) -> Column:
    """Amounts with a currency behind them, as (raw, normalized)."""
    return F.transform(_all(c, MONEY), lambda x: F.struct(F.trim(x).alias("raw"), F.regexp_replace(F.regexp_replace(F.lower(x), rf"(?U)[{SPACE}]+", ""), ",", ".").alias("normalized")))


def _plain(c, pattern: str) -> Column:
    return F.transform(_all(c, pattern), lambda x: F.struct(F.trim(x).alias("raw"), normalized(x).alias("normalized")))


def written_dates(c: str | Column) -> Column:
    """Dates in digits or with the name of a month, as (raw, normalized)."""
    return _plain(c, DATE)


def durations(c: str | Column) -> Column:
    return _plain(c, DURATION)


def references(c: str | Column) -> Column:
    return _plain(_bounded(c), REFERENCE.replace("A-Z0-9", "A-Z0-9\u212a\u017f"))


#: Facts of a text. The types are in the order of their bits in `type_bits`.
FACT = "array<struct<field_type:string,raw_value:string,normalized_value:string,category:string,confidence:double>>"
TYPES = ("amount", "date", "duration", "reference", "jurisdiction", "confidentiality", "termination_clause", "liability_clause", "clause_text")
#: Facts of these types are of use for any category.
ALWAYS = ("amount", "date", "duration")
# Fixed values: (type, how it is found, category where the text hits that group, category else, confidence).
VALUES = (("amount", money, "payment", "liability", 1.0), ("date", written_dates, "effective_date", "effective_date", 1.0), ("duration", durations, "termination", "general", 0.9), ("reference", references, "reference", "reference", 0.8))
# Fixed values: (type, category whose keywords make a sentence one, confidence, whether only without other facts of the category).
SENTENCES = (("jurisdiction", "governing_law", 0.75, False), ("confidentiality", "confidentiality", 0.7, False), ("termination_clause", "termination", 0.65, True), ("liability_clause", "liability", 0.65, True))


def _fact(kind: str, raw: Column, norm: Column, category: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("field_type"), raw.alias("raw_value"), norm.alias("normalized_value"), category.alias("category"), F.lit(confidence).alias("confidence"))


def _firsts(found: Column) -> Column:
    """Of (raw, normalized) values the first of each normalized one."""
    keys = F.transform(found, lambda x: x["normalized"])
    return F.filter(found, lambda x, i: F.array_position(keys, x["normalized"]) == i + 1)


def _same(batches):
    yield from batches


def with_facts(df: DataFrame, text: str, out: str = "facts", wanted: str | Column | None = None) -> DataFrame:
    """``df`` with the facts of ``text`` as an array, each fact once; null texts have none.

    With ``wanted``, facts of other categories are left out, but for those in ALWAYS. A sentence
    stands for a category that has no value of its own; a text with an obligation and no other
    fact gives its first sentence.
    """
    none = F.array().cast(FACT)
    asked = F.coalesce(wanted if isinstance(wanted, Column) else F.lit(wanted), F.lit(""))
    passes = lambda kind, category: F.lit(kind in ALWAYS) | asked.isin("", "general") | (category == asked)
    rows = df.drop(out).withColumn("_text", F.coalesce(col(text), F.lit(""))).withColumn("_flat", normalized("_text"))
    rows = rows.withColumns({f"_hit_{name}": contains_any(F.col("_flat"), words) for name, words in KEYWORDS.items()})
    rows = rows.withColumns({f"_all_{kind}": find("_text") for kind, find, *_ in VALUES})
    made = []
    for kind, _, hit, other, confidence in VALUES:
        category = F.when(F.col(f"_hit_{hit}"), F.lit(hit)).otherwise(F.lit(other))
        facts = F.transform(_firsts(F.col(f"_all_{kind}")), lambda x: _fact(kind, x["raw"], x["normalized"], category, confidence))  # noqa: B023
        made.append(F.filter(facts, lambda f: (f["normalized_value"] != "") & passes(kind, f["category"])))  # noqa: B023
    rows = rows.withColumn("_values", F.concat(*made))
    said = []
    for kind, category, confidence, alone in SENTENCES:
        sentence = first_sentence_with("_text", KEYWORDS[category])
        taken = F.exists("_values", lambda f: f["category"] == category) if alone else F.lit(False)  # noqa: B023
        fact = F.array(_fact(kind, trimmed(sentence), normalized(sentence), F.lit(category), confidence))
        said.append(F.when(F.col(f"_hit_{category}") & ~taken & passes(kind, F.lit(category)), fact).otherwise(none))
    rows = rows.withColumn(out, F.concat("_values", *said))
    first = first_sentence_with("_text", ())
    clause = F.array(_fact("clause_text", trimmed(first), normalized(first), F.when(asked == "", F.lit("general")).otherwise(asked), 0.5))
    rows = rows.withColumn(out, F.when((F.size(out) == 0) & F.col("_text").rlike(MODAL), clause).otherwise(F.col(out)).cast(FACT))
    made = rows.select(*df.drop(out).columns, out)
    # the batches pass as they are: filters on the facts must not be moved below, where each would work them all out again
    return made.mapInArrow(_same, made.schema)


def type_bits(facts: Column) -> Column:
    """The types of facts as bits of a number."""
    return F.aggregate(facts, F.lit(0), lambda a, f: a.bitwiseOR(F.coalesce(F.create_map(*[F.lit(x) for k, t in enumerate(TYPES) for x in (t, 1 << k)])[f["field_type"]], F.lit(0))))


def selected(facts: Column, category: Column) -> Column:
    """The facts of a category; all of them where it has none, or is general."""
    own = F.filter(facts, lambda f: f["category"] == category)
    return F.when((category == "general") | (F.size(own) == 0), facts).otherwise(own)
