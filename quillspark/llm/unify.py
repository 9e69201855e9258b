"""One consistent form for texts that look the same (problem 5).

The text of a whole Arrow batch is one array of code points. A table gather maps each code
point to its plain twin, offsets make room for the few that stand for several letters,
invisible ones are masked out, and marks are composed onto their letters by searching a
table of pairs, all without a call per row.

Folded: full-width forms, typographic spaces, look-alike letters of other alphabets,
ligatures, Roman numeral signs, hyphens drawn like the ASCII one, zero-width and direction
characters, soft hyphens, decomposed accents, line ends. Kept apart: accents, case, digits,
raised figures, dashes, quotes, punctuation. Leading and trailing white space is dropped as
it can't be seen. Null stays null, an empty or blank text becomes empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import from_codes, slices, to_codes

# Letters of other alphabets drawn like a Latin letter, and that letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ϲ": "c", "ϳ": "j", "օ": "o", "ⅼ": "l", "‐": "-", "‑": "-", "﹣": "-", " ": "\n", " ": "\n", "\u0085": "\n",
}
# Code points that draw nothing.
INVISIBLE = [0xAD, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070)]
TABLE = 0x20000
ZWJ, CR, LF, SPACE = 0x200D, 13, 10, 32


@lru_cache(None)
def _tables():
    fold = np.arange(TABLE, dtype=np.uint32)
    expand: dict[int, list[int]] = {}
    ccc = np.zeros(TABLE, np.uint8)
    pairs: dict[int, int] = {}
    nfd: dict[int, list[int]] = {}
    joins = [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), 0x132, 0x133]
    for c in range(0x80, TABLE):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        ccc[c] = unicodedata.combining(ch)
        if unicodedata.category(ch) == "Zs" and c != 0x1680:
            fold[c] = SPACE
        elif 0xFF01 <= c <= 0xFF5E:
            fold[c] = c - 0xFEE0
        elif c in joins:
            to = unicodedata.normalize("NFKC", ch)
            if len(to) == 1:
                fold[c] = ord(to)
            else:
                expand[c] = [ord(x) for x in to]
        else:
            canonical = unicodedata.normalize("NFC", ch)
            if canonical != ch and len(canonical) == 1:
                fold[c] = ord(canonical)
            split = unicodedata.decomposition(ch)
            if split and split[0] != "<" and canonical == ch and not 0xAC00 <= c < 0xD7B0:
                a, *b = (int(x, 16) for x in split.split())
                if b:
                    pairs[a << 21 | b[0]] = c
                nfd[c] = [ord(x) for x in unicodedata.normalize("NFD", ch)]
    for a, b in LOOK_ALIKES.items():
        fold[ord(a)] = ord(b)
    hidden = np.zeros(TABLE, bool)
    hidden[INVISIBLE] = True
    keys = np.array(sorted(pairs), np.int64)
    decomposes = np.zeros(TABLE, bool)
    decomposes[list(nfd)] = True
    wide = np.zeros(TABLE, bool)
    wide[list(expand)] = True
    picture = np.zeros(TABLE, bool)
    picture[0x1F000:] = True
    picture[0x2600:0x27C0] = True
    picture[0xFE0F] = True
    return fold, hidden, ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), expand, nfd, decomposes, wide, picture


def _spread(codes: np.ndarray, offsets: np.ndarray, at: np.ndarray, table: dict[int, list[int]]):
    """Replace the code points at the positions ``at`` by their sequences in ``table``."""
    values, inverse = np.unique(codes[at], return_inverse=True)
    lengths = np.array([len(table[v]) for v in values.tolist()])
    count = np.ones(len(codes), np.int64)
    count[at] = lengths[inverse]
    begin = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    out = np.empty(begin[-1], np.uint32)
    plain = np.ones(len(codes), bool)
    plain[at] = False
    out[begin[:-1][plain]] = codes[plain]
    sequences = np.zeros((len(values), lengths.max()), np.uint32)
    for k, v in enumerate(values.tolist()):
        sequences[k, : lengths[k]] = table[v]
    for j in range(lengths.max()):
        some = lengths[inverse] > j
        out[begin[at[some]] + j] = sequences[inverse[some], j]
    return out, begin[offsets]


def _keep(codes: np.ndarray, offsets: np.ndarray, kept: np.ndarray):
    count = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kept, out=count[1:])
    return codes[kept], count[offsets]


def _compose(codes: np.ndarray, offsets: np.ndarray):
    """Canonical composition of letters with the marks that follow them within a row."""
    _, _, ccc, keys, composed, _, nfd, decomposes, _, _ = _tables()
    small = np.minimum(codes, TABLE - 1)
    mark = ccc[small] > 0
    if not mark.any():
        return codes, offsets
    first = np.zeros(len(codes) + 1, bool)
    first[offsets[:-1]] = True
    before = np.append(mark[1:] & ~first[1:-1], False)
    if len(at := np.flatnonzero(before & decomposes[small])):
        codes, offsets = _spread(codes, offsets, at, nfd)
        mark = ccc[np.minimum(codes, TABLE - 1)] > 0
        first = np.zeros(len(codes) + 1, bool)
        first[offsets[:-1]] = True
    codes = codes.copy()
    at = np.flatnonzero(mark)
    opens = np.ones(len(at), bool)
    opens[1:] = (np.diff(at) > 1) | first[at[1:]]
    run = np.cumsum(opens) - 1
    codes[at] = codes[at][np.lexsort((ccc[codes[at]], run))]
    start = at[opens]
    length = np.diff(np.append(np.flatnonzero(opens), len(at)))
    base = start - 1
    usable = (start > 0) & ~first[start]
    start, length, base = start[usable], length[usable], base[usable]
    last = np.zeros(len(start), np.int16)
    kept = np.ones(len(codes), bool)
    for r in range(int(length.max()) if len(length) else 0):
        live = length > r
        start, length, base, last = start[live], length[live], base[live], last[live]
        m = start + r
        key = codes[base].astype(np.int64) << 21 | codes[m]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        c = ccc[codes[m]].astype(np.int16)
        fits = (keys[k] == key) & (last < c)
        codes[base[fits]] = composed[k[fits]]
        kept[m[fits]] = False
        last = np.where(fits, last, c)
    return _keep(codes, offsets, kept)


def unify_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of rows given as flat code points; same layout out."""
    fold, hidden, _, _, _, expand, _, _, wide, picture = _tables()
    if not len(codes):
        return codes, offsets
    if codes.max() >= 0x7F or (codes == CR).any():
        small = np.minimum(codes, TABLE - 1)
        gone = hidden[small]
        joiner = codes == ZWJ
        if joiner.any():  # between pictures a joiner changes what is drawn
            pic = picture[small]
            inside = np.zeros(len(codes), bool)
            inside[1:-1] = joiner[1:-1] & pic[:-2] & pic[2:]
            gone &= ~inside
        cr = codes == CR
        follows = np.append(codes[1:] == LF, False)
        follows[offsets[1:-1][offsets[1:-1] > 0] - 1] = False
        gone |= cr & follows
        codes = np.where(cr, LF, np.where(codes < TABLE, fold[small], codes)).astype(np.uint32)
        if gone.any():
            codes, offsets = _keep(codes, offsets, ~gone)
        if len(at := np.flatnonzero(wide[np.minimum(codes, TABLE - 1)])):
            codes, offsets = _spread(codes, offsets, at, expand)
        codes, offsets = _compose(codes, offsets)
    blank = (codes == SPACE) | ((codes >= 9) & (codes <= 13))
    if not len(codes):
        return codes, offsets
    solid = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(~blank, out=solid[1:])
    inked = np.flatnonzero(~blank)
    begin, end = offsets[:-1], offsets[1:]
    some = solid[end] > solid[begin]
    left = np.where(some, inked[np.minimum(solid[begin], max(len(inked) - 1, 0))] if len(inked) else 0, end)
    right = np.where(some, (inked[np.maximum(solid[end] - 1, 0)] + 1) if len(inked) else 0, end)
    delta = np.zeros(len(codes) + 1, np.int64)
    np.add.at(delta, left, 1)
    np.add.at(delta, right, -1)
    return _keep(codes, offsets, np.cumsum(delta[:-1]) > 0)


def unify_array(column: pa.Array) -> pa.Array:
    """The consistent form of an Arrow string column; nulls stay null."""
    codes, offsets = unify_codes(*to_codes(column))
    out = from_codes(codes, offsets).cast(pa.string())
    if column.null_count:
        out = pa.compute.if_else(pa.compute.is_valid(column), out, pa.scalar(None, pa.string()))
    return out


def with_unified(df: DataFrame, column: str, out: str = "unified") -> DataFrame:
    """``df`` with the column ``out`` holding the consistent form of ``column``.

    Other columns pass unchanged, whatever they are called; ``out`` replaces a column of that
    name. Null texts stay null.
    """
    schema = df.drop(out).withColumn(out, F.lit("").cast("string")).schema
    schema[out].nullable = True
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                cols = {n: part.column(n) for n in part.schema.names} | {out: unify_array(part.column(column))}
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def digest(text: str | Column) -> Column:
    """128 bits that stand for a text in joins."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def look_alike_groups(items: DataFrame) -> DataFrame:
    """``items(scope, item_key, content)`` with what its consistent form is compared by.

    Returns distinct (scope, item_key, form, raw): digests of the consistent form and of the
    stored text. Contents in which nothing can be seen (null, empty, blank) are no items: there
    is no text in them to compare.
    """
    kept = items.where(F.col("content").isNotNull()).select("scope", "item_key", "content")
    return with_unified(kept, "content", "unified").where("unified <> ''").select("scope", "item_key", digest("unified").alias("form"), digest("content").alias("raw")).distinct()


def look_alike_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of items of one scope that look the same but are stored differently.

    Only groups with at least two stored texts reach the join, so exact copies of one text,
    however many, cost one row each.
    """
    mixed = groups.groupBy("scope", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("scope", "form")
    rows = groups.join(mixed, ["scope", "form"], "left_semi")
    left = rows.select("scope", "form", F.col("item_key").alias("left_key"), F.col("raw").alias("left_raw"))
    right = rows.select("scope", "form", F.col("item_key").alias("right_key"), F.col("raw").alias("right_raw"))
    pairs = left.join(right, ["scope", "form"]).where("left_key <> right_key and left_raw <> right_raw")
    return pairs.select(F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key")).distinct()
