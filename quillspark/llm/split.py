"""Cutting oversized texts into pieces at natural boundaries (problem 1).

Content-defined chunking: a rolling hash of the last code points marks landmarks that depend
on the text alone. Within the smallest and largest size of a piece the first landmark is
taken and snapped to the nearest end of a paragraph, line or sentence, else of a clause or
word. An edit therefore moves the cuts near it, and the cuts further on fall on the same
words as before.

A piece is never over the limit. The piece after a cut begins ``overlap`` code points before
it, so what is new in the pieces, put together, is the text. Texts up to the limit are one
piece; null texts give none, an empty text gives one empty piece. Letters aren't parted from
their combining marks, nor the two characters of a line end, unless a run of marks alone
exceeds the limit. A text without any boundary (one endless word) is cut at landmarks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points in the rolling hash.
WINDOW = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> np.ndarray:
    """By code point: 1 white space, 2 line end, 4 ends a sentence, 8 ends a clause, 16 closes a quote or bracket, 32 clings to what is before it."""
    import unicodedata

    out = np.zeros(0x20000, np.uint8)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isspace():
            out[c] |= 1
        if unicodedata.combining(ch) or c in (0x200D, 0xFE0F) or 0x1F3FB <= c <= 0x1F3FF:
            out[c] |= 32
    for mark, bit in (("\n\r  \x85", 2), (".!?…。！？", 4), (";:,、，；：", 8), ("\"')]}»”’", 16)):
        for ch in mark:
            out[ord(ch)] |= bit
    return out


def levels(codes: np.ndarray) -> np.ndarray:
    """For each place to cut: 4 after a paragraph, line or sentence, 2 after a clause, 1 after a word, 0 inside one, -1 forbidden."""
    n = len(codes)
    kind = _classes()[np.minimum(codes, 0x1FFFF)]
    space, line, stop, clause, close, cling = ((kind & b) > 0 for b in (1, 2, 4, 8, 16, 32))
    out = np.zeros(n + 1, np.int8)
    if n < 2:
        return out
    # what the last code point that isn't white space was, before each place
    index = np.arange(n)
    inked = np.maximum.accumulate(np.where(~space, index, -1))
    broke = np.maximum.accumulate(np.where(line, index, -1))
    prior = np.maximum(inked[:-1], 0)
    ended = stop[prior] | (close[prior] & stop[np.maximum(prior - 1, 0)])
    at = space[:-1] & ~space[1:]  # the cut falls behind the white space
    inner = out[1:n]
    inner[at] = 1
    inner[at & clause[prior]] = 2
    inner[at & (ended | (broke[:-1] > inked[:-1]))] = 4
    inner[cling[1:] | ((codes[:-1] == 13) & (codes[1:] == 10))] = -1
    inner[codes[:-1] == 0x200D] = -1
    return out


def landmarks(codes: np.ndarray, spacing: int) -> np.ndarray:
    """Places whose last WINDOW code points hash to zero in the low bits, on average one in ``spacing``."""
    h = codes.astype(np.uint64)
    factor = np.uint64(0x100000001B3)
    step = 1
    with np.errstate(over="ignore"):
        while step < WINDOW:
            before = np.zeros_like(h)
            before[step:] = h[:-step] if step < len(h) else before[step:]
            h = before * factor + h
            factor *= factor
            step *= 2
        h = (h ^ (h >> np.uint64(29))) * _MIX
    bits = max(1, int(np.log2(max(2, spacing))))
    hit = (h >> np.uint64(64 - bits)) == 0
    hit[: WINDOW - 1] = False
    return np.flatnonzero(hit) + 1


def cuts(codes: np.ndarray, limit: int, overlap: int) -> list[int]:
    """The places where a text is cut; between two of them lie at most ``limit - overlap`` code points."""
    if limit <= overlap or overlap < 0:
        raise ValueError(f"the overlap {overlap} must be smaller than the limit {limit}")
    n, core = len(codes), limit - overlap
    if n <= limit:
        return []
    least, reach = max(1, core // 3), max(1, core // 4)
    level = levels(codes)
    marks = landmarks(codes, core // 3)
    out, s = [], 0
    while n - s > core:
        low, high = s + least, s + core
        k = np.searchsorted(marks, low)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= high else None
        centre = high if mark is None else mark
        a, b = max(low, centre - reach), min(high, centre + reach)
        near = level[a : b + 1]
        cut = None
        for least_level in (4, 2, 1):
            places = np.flatnonzero(near >= least_level)
            if len(places):
                cut = a + int(places[np.argmin(np.abs(places + a - centre))])
                break
        if cut is None:
            whole = np.flatnonzero(level[low : high + 1] >= 1)
            if len(whole):
                cut = low + int(whole[np.argmin(np.abs(whole + low - centre))])
            else:
                allowed = np.flatnonzero(level[s + 1 : centre + 1] >= 0)
                cut = s + 1 + int(allowed[-1]) if len(allowed) else centre
        out.append(cut)
        s = cut
    return out


def with_pieces(df: DataFrame, text: str, limit: str, overlap: str) -> DataFrame:
    """One row per piece of ``text``: the other columns, piece_no from 0, new_pos, start_pos, end_pos, piece.

    ``limit`` and ``overlap`` are columns, in code points. The piece is the text from start_pos
    to end_pos, of which the part from new_pos on is new. A null limit means none. Columns with
    the names of the results are replaced, ``text`` is left out.
    """
    added = ["piece_no", "new_pos", "start_pos", "end_pos", "piece"]
    others = [c for c in df.columns if c not in (*added, text)]
    kept = [f"c{i}" for i in range(len(others))]
    source = df.where(F.col(text).isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(others, kept)], F.col(text).alias("t"), F.col(limit).cast("int").alias("lim"), F.col(overlap).cast("int").alias("lap"))
    schema = T.StructType([*source.select(*kept).schema.fields, *(T.StructField(c, T.IntegerType()) for c in added[:-1]), T.StructField("piece", T.StringType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            take, no, new, start, end, piece = [], [], [], [], [], []
            for row, (t, lim, lap) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "lim", "lap")))):
                bounds = [0, len(t)]
                if lim is not None and len(t) > lim:
                    bounds[1:1] = cuts(np.frombuffer(t.encode("utf-32-le"), np.uint32), lim, lap or 0)
                for k in range(len(bounds) - 1):
                    take.append(row)
                    no.append(k)
                    new.append(bounds[k])
                    start.append(max(0, bounds[k] - (lap or 0)) if k else 0)
                    end.append(bounds[k + 1])
                    piece.append(t[start[-1] : end[-1]])
            rows = batch.select(kept).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int32()) for x in (no, new, start, end)), pa.array(piece, pa.string())], names=names)

    return source.mapInArrow(run, schema).toDF(*others, *added)
