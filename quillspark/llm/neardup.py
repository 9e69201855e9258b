"""Groups of texts that are edited copies of one another (problem 6).

Texts are compared in the consistent form of `unify`, as sequences of lower-case words. The
similarity of two texts is the number of different three-word sequences in both over the
number in either. Candidates come from Order MinHash: each of ``sketches`` hash functions
picks the ``picked`` smallest of a text's occurrence-labelled k-mers and keeps them in text
order, so texts meet that share content in the same order. Candidates that can't reach the threshold,
by how their sequences fall into bins, are dropped; the others are verified by a banded alignment of their three-word sequences; where the band alone doesn't settle it, as
after reordering, by counting all of them. No pair is taken or dropped on an estimate.

Texts with equal sets of sequences form a class first, so copies, however many, take part
once. A bucket of more than ``crowd`` classes isn't paired up: its members go to an exact
join on the rarest sequences of each class, which two classes over the threshold must share.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .codepoints import slices, to_codes
from .unify import unify_codes

KMER, PICKED, SKETCHES, CROWD = 4, 2, 40, 200
#: Sizes of sets are told apart in buckets by powers of this.
SIZE_STEP = 1.1
#: Half the width of the band, in sequences.
BAND = 12
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: its lower case, 0 where it is no letter or digit."""
    out = np.zeros(0x33480, np.uint32)
    for c in range(0x33480):
        if (ch := chr(c)).isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def word_hashes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of each word of all rows, and the offsets of the rows in words."""
    low = _letters()[np.minimum(codes, 0x3347F)]
    inside = low > 0
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    count = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(begins, out=count[1:])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        ends = starts + np.add.reduceat(np.where(inside, 1, 0), starts)  # gaps add nothing
        place = np.arange(len(codes)) - starts[np.maximum(count[1:] - 1, 0)]
        powers = np.cumprod(np.full(int(place.max()) + 1 if len(place) else 1, _BASE, np.uint64)) if len(place) else None
        value = np.where(inside, (low.astype(np.uint64) + np.uint64(1)) * powers[np.maximum(place, 0)], np.uint64(0))
        h = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _C)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32), count[offsets]


def grams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-word sequences of each row, in text order, and their row offsets."""
    size = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], size)
    h = np.zeros(len(at), np.uint64)
    u = words.view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = mix(h * _BASE + u[at + j] + np.uint64(j + 1))
    return h, out


def occurrences(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each value occurred before in its row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    index = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(~same, index, 0))
    out = np.empty(len(h), np.int64)
    out[order] = index - begin
    return out


def order_sketches(words: np.ndarray, offsets: np.ndarray, k: int = KMER, picked: int = PICKED, sketches: int = SKETCHES) -> np.ndarray:
    """(rows, sketches) Order MinHash values; rows with no k-mer get the number of their row."""
    h, at = grams(words, offsets, k)
    rows = len(at) - 1
    out = np.repeat(mix(np.arange(rows, dtype=np.uint64))[:, None], sketches, 1)
    some = np.flatnonzero(np.diff(at) > 0)
    if not len(some):
        return out
    begins, sizes = at[some], np.diff(at)[some]
    with np.errstate(over="ignore"):
        labelled = mix(h + occurrences(h, at).astype(np.uint64) * _C)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _C) | np.uint64(1)
    with np.errstate(over="ignore"):
        for s in range(sketches):
            # the values are well mixed, so two rounds with a factor of its own give each sketch its order
            v = (labelled ^ factors[s]) * factors[s]
            v = (v ^ (v >> np.uint64(32))) * _B
            chosen = []
            for r in range(picked):
                low = np.minimum.reduceat(v, begins)
                place = np.flatnonzero(v == np.repeat(low, sizes))
                if len(place) != len(begins):
                    _, one = np.unique(np.searchsorted(begins, place, "right") - 1, return_index=True)
                    place = place[one]
                chosen.append(np.where(low == top, np.int64(-1), place))
                v[place] = top
            places = np.sort(np.stack(chosen), axis=0)
            key = np.full(len(some), np.uint64(s + 1))
            for p in places:
                key = mix(key * _BASE + np.where(p < 0, np.uint64(0), labelled[p]))
            out[some, s] = key
    return out


def with_words(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, form, n, words) of texts of at least ``least`` words: a digest of the set of their three-word sequences, its size, and word hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                codes, offsets = unify_codes(*to_codes(part.column(text)))
                words, at = word_hashes(codes, offsets)
                h, gat = grams(words, at, 3)
                rows = np.flatnonzero(np.diff(at) >= least)
                sets = [np.unique(h[gat[r] : gat[r + 1]]) for r in rows]
                forms, sizes = [hashlib.md5(x.tobytes()).digest() for x in sets], [len(x) for x in sets]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words)).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows)), pa.array(forms, pa.binary()), pa.array(sizes, pa.int32()), lists], names=["key", "form", "n", "words"])

    source = df.where(F.col(text).isNotNull() & (F.char_length(text) >= 2 * least - 1)).select(key, text)
    return source.mapInArrow(run, "key string, form binary, n int, words array<int>")


def _words_of(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sketched(classes: DataFrame, k: int, picked: int, sketches: int, crowd: int) -> DataFrame:
    """(sketch, cid): the entries of buckets. Of a bucket that is crowded within a batch already only ``crowd`` + 1 entries go on as such.

    The others, whose bucket is thereby known to be crowded, come as entries of their own, with
    -1 - cid, so a bucket that many classes share isn't brought to one task.
    """

    def run(batches):
        for batch in batches:
            values = order_sketches(*_words_of(batch.column("words")), k, picked, sketches).reshape(-1).view(np.int64)
            cid = np.repeat(batch.column("cid").to_numpy(), sketches)
            # entries stay in the order of their classes, in which they take least room on the way
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            alone = np.zeros(len(values), bool)
            alone[order] = np.arange(len(values)) - np.repeat(begins, np.diff(np.append(begins, len(values)))) > crowd
            if alone.any():
                values = np.where(alone, mix(cid.view(np.uint64)).view(np.int64), values)
                cid = np.where(alone, -1 - cid, cid)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(cid)], names=["sketch", "cid"])

    return classes.select("cid", "words").mapInArrow(run, "sketch long, cid long")


def _met(entries: DataFrame, crowd: int, apart: int) -> DataFrame:
    """Pairs (cid_a < cid_b) of classes in one bucket; a member of a crowded bucket comes out alone, cid_b null.

    Pairs whose sizes are more than ``apart`` steps from each other can't be similar enough and stay out.

    Reads each partition as a stream sorted by bucket, so a bucket of any size takes no more
    memory than ``crowd`` entries.
    """

    def run(batches):
        carry_s, carry_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        crowded = None  # the bucket at hand, once it is known to be crowded
        for batch in batches:
            s, c = batch.column("sketch").to_numpy(), batch.column("cid").to_numpy()
            told = c < 0
            yield from lone(-1 - c[told])
            s, c = np.concatenate([carry_s, s[~told]]), np.concatenate([carry_c, c[~told]])
            alone = np.zeros(0, np.int64)
            if crowded is not None:
                stay = int(np.searchsorted(s != crowded, True)) if (s != crowded).any() else len(s)
                alone, s, c = c[:stay], s[stay:], c[stay:]
                crowded = crowded if not len(s) else None
            if len(s):
                tail = int(np.flatnonzero(np.append(True, s[1:] != s[:-1]))[-1])
                if len(s) - tail > crowd:
                    crowded, tail = s[-1], len(s)
                yield from bucket(s[:tail], c[:tail], alone)
                carry_s, carry_c = s[tail:], c[tail:]
            else:
                carry_s, carry_c = s, c
                yield from bucket(s, c, alone)
        yield from bucket(carry_s, carry_c, np.zeros(0, np.int64))

    def lone(c):
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64())], names=["cid_a", "cid_b"])

    def bucket(s, c, alone):
        if len(s):
            begins = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sizes = np.diff(np.append(begins, len(s)))
            big = np.repeat(sizes > crowd, sizes)
            alone = np.concatenate([alone, c[big]])
            s, c = s[~big], c[~big]
        yield from lone(alone)
        for d in range(1, crowd):
            same = s[d:] == s[:-d] if len(s) > d else np.zeros(0, bool)
            if not same.any():
                break
            a, b = c[:-d][same], c[d:][same]
            near = np.abs((a & 255) - (b & 255)) <= apart
            a, b = a[near], b[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["cid_a", "cid_b"])

    return entries.repartition("sketch").sortWithinPartitions("sketch").mapInArrow(run, "cid_a long, cid_b long")


def _first_grams(column) -> tuple[np.ndarray, np.ndarray]:
    """The different three-word sequences of each row, in text order."""
    h, at = grams(*_words_of(column), 3)
    kept = occurrences(h, at) == 0
    count = np.zeros(len(h) + 1, np.int64)
    np.cumsum(kept, out=count[1:])
    return h[kept], count[at]


def similarities(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, threshold: float, band: int = BAND) -> np.ndarray:
    """Per pair of rows the similarity of two lists of different values; exact from ``threshold`` on.

    Values that lie within the band of each other's place are matched first. If they alone
    reach the threshold or all values are matched, nothing else is looked up.
    """
    na, nb = np.diff(a_at), np.diff(b_at)
    pair = np.repeat(np.arange(len(na)), na)
    place = np.arange(len(a)) - a_at[pair]
    found = np.zeros(len(a), bool)
    for d in range(-band, band + 1):
        other = place + d
        ok = (other >= 0) & (other < nb[pair])
        found |= ok & (b[np.where(ok, b_at[pair] + other, 0)] == a) if len(b) else False
    both = np.bincount(pair[found], minlength=len(na)).astype(np.int64)
    need = np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
    open_rows = (both < np.minimum(na, nb)) & (np.minimum(na, nb) >= need)
    if open_rows.any():
        left = open_rows[pair] & ~found
        pair_b = np.repeat(np.arange(len(nb)), nb)
        right = open_rows[pair_b]
        owner = np.concatenate([pair[left], pair_b[right]])
        value = np.concatenate([a[left], b[right]])
        order = np.lexsort((value, owner))
        twin = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        both += np.bincount(owner[order][1:][twin], minlength=len(na)).astype(np.int64)
    return both / np.maximum(na + nb - both, 1)


def _possible(pairs: pa.RecordBatch, threshold: float, bins: int = 128) -> np.ndarray:
    """Which pairs can reach the threshold: sequences fall into bins, and the two share at most the smaller count of each bin."""
    counts = []
    for side in ("words_a", "words_b"):
        h, at = grams(*_words_of(pairs.column(side)), 3)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        cell = row * bins + (h >> np.uint64(40)).astype(np.int64) % bins
        counts.append(np.bincount(cell, minlength=(len(at) - 1) * bins).reshape(-1, bins))
    most = np.minimum(*counts).sum(1)
    both = pairs.column("n_a").to_numpy().astype(np.int64) + pairs.column("n_b").to_numpy()
    return most >= threshold / (1 + threshold) * both - 1e-9


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                part = part.filter(pa.array(_possible(part, threshold)))
                if not part.num_rows:
                    continue
                s = similarities(*_first_grams(part.column("words_a")), *_first_grams(part.column("words_b")), threshold)
                part = part.append_column("similarity", pa.array(s))
                yield part.filter(pa.array(s >= threshold - 1e-12)).select(["form_a", "form_b", "similarity"])

    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return pairs.where(near).select("form_a", "n_a", "words_a", "form_b", "n_b", "words_b").mapInArrow(run, "form_a binary, form_b binary, similarity double")


def _crowded(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs among ``members`` that share one of the rarest sequences of each: none over the threshold is missed."""

    def run(batches):
        for batch in batches:
            h, at = _first_grams(batch.column("words"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(), np.diff(at))), pa.array(np.repeat(np.diff(at), np.diff(at)).astype(np.int32)), pa.array(h.view(np.int64))], names=["cid", "n", "gram"])

    every = classes.join(members, "cid", "left_semi").select("cid", "words").mapInArrow(run, "cid long, n int, gram long")
    counts = every.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("cid").orderBy("df", "gram")
    ranked = every.join(counts, "gram").withColumn("place", F.row_number().over(order))
    prefix = ranked.where((F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1) & (F.col("df") > 1)).select("gram", "cid", "n")
    a, b = (prefix.select("gram", F.col("cid").alias(f"cid_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, "gram").where((F.col("cid_a") < F.col("cid_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)).select("cid_a", "cid_b").distinct()


def near_copies(df: DataFrame, key: str, text: str, threshold: float = 0.8, least_words: int = 24, k: int = KMER, picked: int = PICKED, sketches: int = SKETCHES, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(members, links): every key with the digest of its class, and the pairs of similar classes.

    members(key, form), links(form_a, form_b, similarity), form_a < form_b. Null texts and texts
    of fewer than ``least_words`` words are in neither.
    """
    rows = materialize(with_words(df, key, text, least_words).where("key is not null"), "words")
    members = rows.select("key", "form").distinct()
    # a class is known in buckets by 52 bits of its digest and the step of its size; classes that
    # share them are told apart by their whole digest later
    step = F.least(F.lit(255), F.floor(F.log(F.col("n")) / math.log(SIZE_STEP))).cast("long")
    cid = F.conv(F.substring(F.hex("form"), 1, 13), 16, 10).cast("long") * 256 + step
    classes = materialize(rows.groupBy("form").agg(F.first("n").alias("n"), F.first("words").alias("words")).withColumn("cid", cid), "classes")
    apart = math.floor(math.log(1 / threshold) / math.log(SIZE_STEP)) + 1
    candidates = materialize(_met(_sketched(classes, k, picked, sketches, crowd), crowd, apart).distinct(), "candidates")
    hot = candidates.where("cid_b is null").select(F.col("cid_a").alias("cid"))
    candidates = candidates.where("cid_a < cid_b").unionByName(_crowded(classes, hot, threshold)).distinct()
    left = classes.select(F.col("cid").alias("cid_a"), F.col("form").alias("form_a"), F.col("n").alias("n_a"), F.col("words").alias("words_a"))
    right = classes.select(F.col("cid").alias("cid_b"), F.col("form").alias("form_b"), F.col("n").alias("n_b"), F.col("words").alias("words_b"))
    links = _verified(candidates.join(left, "cid_a").join(right, "cid_b"), threshold)
    ordered = links.select(F.least("form_a", "form_b").alias("form_a"), F.greatest("form_a", "form_b").alias("form_b"), "similarity")
    return members, materialize(ordered.where("form_a <> form_b").distinct(), "links")
