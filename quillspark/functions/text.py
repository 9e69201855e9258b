"""Text functions as Column expressions: normalisation, tokens, splits, hints, categories.

Nulls give null unless a function says otherwise. White space is what Unicode calls so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode as a character class, without the brackets, for Java expressions.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same as a string of all those characters.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: The same as one Java class, which is quicker to match than many ranges; only for expressions that have no other sign of a class.
SPACE = r"\s\x1c-\x1f"
# Keyword groups in their order of precedence; keywords match anywhere in a text.
KEYWORDS = {
    "liability": ("liability", "responsabil", "cap", "limitation of liability", "plafond"),
    "termination": ("termination", "terminate", "resiliation", "résiliation", "notice", "préavis", "preavis"),
    "effective_date": ("effective date", "date d'effet", "entry into force", "date de prise d'effet"),
    "payment": ("payment", "paiement", "invoice", "facture", "due", "échéance", "echeance"),
    "governing_law": ("governing law", "droit applicable", "jurisdiction", "tribunal", "court"),
    "confidentiality": ("confidentiality", "confidential", "confidentiel", "nda"),
    "reference": ("reference", "ref", "référence", "revision", "version"),
}
#: Marks stripped from both ends of a clause token.
STRIPPED = ".,;:!?()[]{}\"'"


def spaced(pattern: str, space: str = WS) -> str:
    """``pattern`` with its white-space sign standing for all that is white space in Unicode, also within character classes."""
    out, inside, k = "", False, 0
    while k < len(pattern):
        sign = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        inside = inside or sign == "["
        inside = inside and sign != "]"
        out += sign if sign != r"\s" else space if inside else f"[{space}]"
        k += len(sign)
    return out


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def normalized(c: str | Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), rf"(?U)[{SPACE}]+", " "))


def trigrams(c: str | Column) -> Column:
    """The different three-character sequences of the normalised text; the text itself if it is shorter, none if empty."""
    n = normalized(c)
    # a look-ahead at every place, but not between the two halves that Java stores some characters as
    threes = F.regexp_extract_all(n, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{3}))"), 1)
    return F.when(n.isNull(), F.lit(None)).when(F.char_length(n) >= 3, F.array_distinct(threes)).when(n == "", F.array().cast("array<string>")).otherwise(F.array(n))


def tokens(c: str | Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text, in order; accented letters part them."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), 0)


def pieces(c: str | Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(col(c), F.lit(rf"(?U)[^{SPACE}]+"), 0)


def clause_tokens(c: str | Column) -> Column:
    """Runs without white space, stripped of marks at both ends, in lower case; may be empty strings."""
    return F.transform(pieces(c), lambda t: F.btrim(F.lower(t), F.lit(STRIPPED)))


def token_count(c: str | Column) -> Column:
    return F.size(pieces(c))


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Compressed over original size; 1 where the original is empty, never below 0."""
    return F.when(original <= 0, F.lit(1.0)).otherwise(F.greatest(compressed, F.lit(0)) / original)


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def paragraphs(c: str | Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones; the whole text if there is none."""
    parts = _kept(F.split(col(c), rf"(?U)\n[{SPACE}]*\n"))
    return F.when(col(c).isNull(), F.lit(None)).when(F.size(parts) > 0, parts).otherwise(F.array(col(c)))


def sentences(c: str | Column) -> Column:
    """Parts after . ! ? ; : and white space, or at line ends; trimmed, without empty ones."""
    return _kept(F.split(col(c), rf"(?U)(?<=[.!?;:])[{SPACE}]+|\n+"))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_sentence_with(c: str | Column, words) -> Column:
    """The first chunk after . ; : or a line end that has one of ``words``, else the first; cut to 240."""
    chunks = _kept(F.split(col(c), rf"(?U)(?<=[.;:])[{SPACE}]+|\n+"))
    # a chunk is normalised once, whatever the number of words
    flat = F.transform(chunks, lambda x: F.struct(x.alias("chunk"), normalized(x).alias("flat")))
    fitting = F.get(F.filter(flat, lambda x: contains_any(x["flat"], words)), F.lit(0))["chunk"] if words else F.lit(None).cast("string")
    chosen = F.coalesce(fitting, F.get(chunks, F.lit(0)), trimmed(c))
    return F.left(chosen, F.lit(240))


def section_hint(c: str | Column) -> Column:
    """What the first line says a text is about, or null.

    A short first line counts if it is marked as a heading, in capitals, begins with section,
    article or clause, or names a keyword group; a shorter one without a colon if more lines follow.
    """
    lines = _kept(F.split(col(c), "\n+"))
    first = F.btrim(F.get(lines, F.lit(0)), F.lit(" :.-"))
    norm = normalized(first)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    heading = F.startswith(first, F.lit("#")) | upper | norm.rlike(r"^(section|article|clause)\b") | norm.isin(*KEYWORDS, "general")
    long = F.char_length(first)
    return F.when((F.size(lines) == 0) | (norm == ""), F.lit(None)).when((long <= 90) & heading, trimmed(F.ltrim(first, F.lit("# ")))).when((long <= 60) & ~F.contains(first, F.lit(":")) & (F.size(lines) > 1), first)


def shortened(c: str | Column, limit: int) -> Column:
    """White space collapsed; cut to ``limit`` with an ellipsis if longer."""
    flat = F.trim(F.regexp_replace(col(c), rf"(?U)[{SPACE}]+", " "))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 1))), F.lit("…")))


def category(c: str | Column) -> Column:
    """The first keyword group that a text hits; else payment for amounts, effective_date for dates, general."""
    from .extract import DATE, MONEY

    n = normalized(c)
    out = F
    for name, words in KEYWORDS.items():
        out = out.when(contains_any(n, words), F.lit(name))
    return out.when(n.rlike(MONEY), F.lit("payment")).when(n.rlike(DATE), F.lit("effective_date")).otherwise(F.lit("general"))
