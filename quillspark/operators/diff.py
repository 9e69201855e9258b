"""Word differences of two texts and what kind of change they are.

Finding the steps needs matching blocks and runs in Arrow batches; what a difference is called
and how much it changes are Column expressions over its steps.
"""

from __future__ import annotations

import difflib
import re
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from ..functions import text as T

_PIECE = re.compile(r"\S+|\s+")
#: Steps from one text to another.
OPS = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))
# What a number, a date and a reference look like in a change, and words that mark a clause.
NUMBER = r"(?i)\b\d[\d\s.,]*(?:€|eur|usd|\$|mad)?\b"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2})\b"
REFERENCE = r"(?i)\b[A-Z]{1,6}[-_/]?\d+[A-Z0-9._/-]*\b"
CLAUSE_WORDS = ("shall", "must", "will", "may not", "doit", "devra", "notice", "termination")
KINDS = {"numeric_change": NUMBER, "date_change": DATE, "reference_change": REFERENCE}
# Bounds of a whole value, of changed words, and of words that are shown letter by letter.
VALUE_CHARS, LOCAL_CHARS, LOCAL_WORDS = 48, 72, 10
LETTER_CHARS, LETTER_WORDS, LETTER_LIKENESS = 80, 6, 0.45


def ratio(a: str, b: str, junk: bool = False) -> float:
    """Similarity of two texts by matching blocks; it depends on their order."""
    return difflib.SequenceMatcher(None, a, b, autojunk=junk).ratio()


def bounded_ratio(a: str, b: str, least: float) -> float:
    """The similarity where it reaches ``least``, else a number below ``least``: cheap upper bounds are tried first."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if 2 * min(len(a), len(b)) / (len(a) + len(b)) < least:
        return 0.0
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.ratio() if m.quick_ratio() >= least else 0.0


def _blocks(a, b):
    """(tag, old, new) of the matching and differing stretches of two sequences of strings."""
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        yield tag, "".join(a[i:j]), "".join(b[k:m])


def _sides(tag: str, old: str, new: str) -> list[tuple[str, str]]:
    return [("equal", old)] if tag == "equal" else [s for s in (("delete", old), ("insert", new)) if s[1]]


def _by_letters(tag: str, old: str, new: str) -> bool:
    """Whether a replacement is small and alike enough to be shown letter by letter."""
    sides = [old.strip(), new.strip()]
    small = all(s and "\n" not in s and len(s) <= LETTER_CHARS and len(s.split()) <= LETTER_WORDS for s in sides)
    return tag == "replace" and small and ratio(*sides) >= LETTER_LIKENESS


def word_diff(left: str | None, right: str | None) -> list[tuple[str, str]]:
    """(op, text) from left to right by words; replacements that are nearly alike by letters."""
    words = _blocks(_PIECE.findall(left or ""), _PIECE.findall(right or ""))
    fine = (_blocks(old, new) if _by_letters(tag, old, new) else [(tag, old, new)] for tag, old, new in words)
    steps = chain.from_iterable(_sides(*x) for x in chain.from_iterable(fine))
    return [(op, "".join(text for _, text in same)) for op, same in groupby(steps, key=itemgetter(0))]


def _appended(df: DataFrame, out: str, kind: DataType, columns: list[str], make, arrow: pa.DataType) -> DataFrame:
    """``df`` with ``out``, made of the values of ``columns`` row by row; null where any of them is."""
    base = df.drop(out)
    kept = [f"c{i}" for i in range(len(base.columns))]
    which = [kept[base.columns.index(c)] for c in columns]
    source = base.toDF(*kept)
    schema = StructType([*source.schema.fields, StructField("made", kind)])
    names = schema.names

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in which))
            made = pa.array([None if None in row else make(*row) for row in rows], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=names)

    return source.mapInArrow(run, schema).toDF(*base.columns, out)


def with_ops(df: DataFrame, left: str, right: str, out: str = "ops") -> DataFrame:
    """``df`` with the steps from one text to another; null where either is."""
    step = pa.struct([("op", pa.string()), ("text", pa.string())])
    return _appended(df, out, OPS, [left, right], lambda a, b: [{"op": op, "text": t} for op, t in word_diff(a, b)], pa.list_(step))


def with_likeness(df: DataFrame, left: str, right: str, least: float = 0.0, junk: bool = False, out: str = "alike") -> DataFrame:
    """``df`` with the similarity of two texts where it reaches ``least``, else a number below it; null where either text is."""
    return _appended(df, out, DoubleType(), [left, right], lambda a, b: ratio(a, b, junk) if least <= 0 else bounded_ratio(a, b, least), pa.float64())


def _joined(ops: Column, kind: str) -> Column:
    return F.array_join(F.transform(F.filter(ops, lambda o: o["op"] == kind), lambda o: o["text"]), "")


def classify(left: Column, right: Column, ops: Column) -> Column:
    """numeric, date, reference, clause or text change: what both short values, else what both changed parts look like."""
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    old, new = T.trimmed(_joined(ops, "delete")), T.trimmed(_joined(ops, "insert"))
    longest = lambda x, y, size: F.greatest(size(x), size(y))
    plain = ~F.contains(a, F.lit("\n")) & ~F.contains(b, F.lit("\n")) & (T.trimmed(a) != T.trimmed(b))
    whole = plain & (longest(T.trimmed(a), T.trimmed(b), F.char_length) <= VALUE_CHARS)
    part = (old != "") & (new != "") & (longest(old, new, F.char_length) <= LOCAL_CHARS) & (longest(old, new, T.token_count) <= LOCAL_WORDS)
    rules = [(applies & x.rlike(f"(?U){pattern}") & y.rlike(f"(?U){pattern}"), kind) for applies, x, y in ((whole, a, b), (part, old, new)) for kind, pattern in KINDS.items()]
    rules.append((T.contains_any(F.lower(F.concat_ws("\n", a, b)), CLAUSE_WORDS), "clause_change"))
    return F.coalesce(*[F.when(rule, F.lit(kind)) for rule, kind in rules], F.lit("text_change"))


def changed_words(ops: Column) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"] != "equal"), F.lit(0), lambda n, o: n + T.token_count(o["text"]))


def focus(ops: Column) -> Column:
    """What the steps take away and bring in, as a sentence; empty where they do neither."""
    part = lambda kind: T.shortened(F.array_join(F.filter(F.transform(F.filter(ops, lambda o: o["op"] == kind), lambda o: T.trimmed(o["text"])), lambda t: t != ""), " "), 72)
    old, new = F.coalesce(part("delete"), F.lit("")), F.coalesce(part("insert"), F.lit(""))
    # The sentences.
    both = F.format_string("Le texte passe de '%s' à '%s'.", old, new)
    return F.when((old != "") & (new != ""), both).when(new != "", F.format_string("Le texte ajoute '%s'.", new)).when(old != "", F.format_string("Le texte supprime '%s'.", old)).otherwise("")
