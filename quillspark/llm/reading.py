"""Reading level of texts (problem 9).

A regularised ordinal regression (proportional odds) over features of a text: length of
sentences and words, lexical diversity, rarity of words in the whole collection, connectives,
and a proxy for the depth of clauses. It is fitted to graded texts, of each language by
itself, with features scaled to the graded texts of that language, so its thresholds are on
the scale of the grades. The language of a text is told from its function words, as given
language columns can't be relied on.

The features of a whole batch are computed at once on arrays of code points: lines, brackets,
sentence ends and words are positions in them, and what is counted by sentence or text is
summed over those positions.

Headings, table rows, bullets and what stands in brackets are no sentences and are left out.
Texts of fewer than ``least`` words (runs without white space) and null texts have no level.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .codepoints import slices, to_codes

#: Share of all words below which words are equally rare. It bounds the words whose own share is kept to 1/SHARE, at any size of the collection alike.
SHARE = 1e-6
#: A word is rare if its share is below this one.
RARE = 5e-5
#: Words in a window of the diversity feature; windows begin every half of it, and the last ends with the text.
WINDOW = 60
#: Bytes of text whose features are computed at once.
PORTION = 1 << 21
# Function words that tell the language, and connectives by language.
FUNCTION = {
    "en": set("the of to and a in is for on that with be by as at this it or are any not shall must our we you has was from your".split()),
    "fr": set("le la les de des du et à un une est en que qui pour par sur dans ne pas au aux ou se ce son sa cette toute tout nous vous il elle on".split()),
}
CONNECTIVES = {
    "en": set("because although whereas while unless provided since once until if when after before so but however therefore furthermore moreover which whereby insofar notwithstanding irrespective despite pursuant where though hence thus accordingly conversely subject save pending".split()),
    "fr": set("parce bien tandis sauf pourvu puisque dès lorsque quand si après avant donc mais cependant toutefois ainsi dont lequel laquelle nonobstant malgré indépendamment conformément sous réserve mesure car alors puis lors condition préjudice attente".split()),
}
RELATIVES = {"which", "that", "whereby", "who", "qui", "que", "dont", "où", "lequel"}
LANGS = list(FUNCTION)
NAMES = ["sentence_mean", "sentence_median", "word_mean", "long_share", "very_long_share", "diversity", "rarity", "rare_share", "connectives", "clauses"]
_BASE = np.uint64(0x100000001B3)


# classes of code points, as bits
SPACE, LETTER, CAPITAL, END, CLOSER, OPENER, CLAUSE, STOP = (1 << k for k in range(8))
_SIGNS = {END: ".!?…", CLOSER: "\"'»)]", OPENER: "\"«(", CLAUSE: ",;:", STOP: ".!?;…"}
# lists of words, as bits; those of a language by its number in LANGS
RELATIVE, _FUNCTION, _CONNECTIVE = 1, (2, 4), (8, 16)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point its classes, and its lower case."""
    every = [chr(c) for c in range(0x30000)]
    small = {*range(ord("a"), ord("z") + 1), *range(0xE0, 0x100)}
    flags = np.zeros(len(every), np.uint8)
    for c, ch in enumerate(every):
        letter = ch.isalnum() and not ch.isdecimal()
        flags[c] = SPACE * ch.isspace() | LETTER * letter | CAPITAL * (letter and c not in small)
    for bit, signs in _SIGNS.items():
        for ch in signs:
            flags[ord(ch)] |= bit
    return flags, np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every], np.uint32)


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    out = np.zeros(len(codes), bool)
    for c in chars:
        out |= codes == ord(c)
    return out


def _hashed(low: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of code points."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        at = np.repeat(np.cumsum(length) - length, length)
        place = np.arange(int(length.sum())) - at
        power = np.cumprod(np.full(int(length.max()) + 1, _BASE, np.uint64))
        value = (low[np.repeat(begin, length) + place].astype(np.uint64) + np.uint64(1)) * power[place]
        out = np.add.reduceat(value, np.cumsum(length) - length)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def hashes_of(words) -> np.ndarray:
    """The hash of each of some words that are in lower case."""
    codes, offsets = to_codes(pa.array(list(words), pa.string()))
    return _hashed(codes, offsets[:-1], np.diff(offsets))


@lru_cache(1)
def _lists() -> tuple[np.ndarray, np.ndarray]:
    """The words of all lists by their hash, in order, and the lists that each is in."""
    bits: dict[str, int] = {}
    for k, lang in enumerate(LANGS):
        for words, bit in ((FUNCTION[lang], _FUNCTION[k]), (CONNECTIVES[lang], _CONNECTIVE[k])):
            for w in words:
                bits[w] = bits.get(w, 0) | bit
    for w in RELATIVES:
        bits[w] = bits.get(w, 0) | RELATIVE
    h = hashes_of(bits)
    order = np.argsort(h)
    return np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(np.array(list(bits.values()), np.uint8)[order], np.uint8(0))


def _listed(words: np.ndarray) -> np.ndarray:
    known, bits = _lists()
    at = np.searchsorted(known, words)
    return np.where(known[at] == words, bits[at], 0)


class Text:
    """The sentences and words of the rows of a flat code-point array."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        table, lower = _classes()
        n, rows = len(codes), len(offsets) - 1
        self.rows, size = rows, np.diff(offsets)
        row = np.repeat(np.arange(rows), size)
        kind = np.minimum(codes, 0x2FFFF)
        flags = table[kind]
        blank = (flags & SPACE) > 0
        index = np.arange(n + 1)
        first = np.zeros(n + 1, bool)
        first[offsets[:-1][size > 0]] = True
        if n:
            first[1:n] |= (codes[:-1] == 10) | (codes[:-1] == 13)
        lines = np.flatnonzero(first[:n])
        stops = np.append(lines[1:], n)
        line = np.cumsum(first[:n]) - 1
        follow = lambda flag: np.minimum.accumulate(np.append(np.where(flag, index[:n], n), n)[::-1])[::-1]
        behind = lambda flag: np.maximum.accumulate(np.where(flag, index[:n], -1))
        char = np.append(codes, [10, 10, 10, 10, 10]).astype(np.int64)
        seen = np.append(blank, [True] * 5)
        p = follow(~blank)[lines]
        empty = p >= stops
        p = np.minimum(p, n)
        # lines that are no running text
        skip = empty | _among(char[p], "#|<") | ((char[p] == ord("!")) & (char[p + 1] == ord("["))) | (np.add.reduceat(codes == ord("|"), lines) >= 2 if len(lines) else empty)
        for word in ("total", "ref"):
            q = np.minimum(p + len(word), n)
            same = np.ones(len(p), bool)
            for j, c in enumerate(word):
                same &= (char[np.minimum(p + j, n)] | 32) == ord(c)
            colon = follow(~blank)[q]
            skip |= same & (colon < stops) & (char[np.minimum(colon, n)] == ord(":"))
        # bullets and numbers before the text of a line
        digits = np.zeros(len(p), np.int64)
        run = np.ones(len(p), bool)
        for j in range(3):
            run &= (char[np.minimum(p + j, n)] >= 48) & (char[np.minimum(p + j, n)] <= 57)
            digits += run
        mark = np.where(_among(char[p], "-•*–"), 1, 0)
        mark = np.where((digits > 0) & _among(char[np.minimum(p + digits, n)], ".)"), digits + 1, mark)
        mark = np.where((char[p] >= 97) & (char[p] <= 122) & (char[np.minimum(p + 1, n)] == ord(")")), 2, mark)
        after = follow(~blank)[np.minimum(p + mark, n)]
        bullet = (mark > 0) & seen[np.minimum(p + mark, n)] & (after < stops)
        begin = np.where(bullet, after, p)
        # what stands in brackets within a line
        masked = np.zeros(n + 1, np.int64)
        for a, b in ("()", "[]"):
            at = np.flatnonzero((codes == ord(a)) | (codes == ord(b)))
            pair = np.flatnonzero((codes[at[:-1]] == ord(a)) & (codes[at[1:]] == ord(b)) & (line[at[:-1]] == line[at[1:]])) if len(at) > 1 else at[:0]
            np.add.at(masked, at[pair], 1)
            np.add.at(masked, at[pair + 1] + 1, -1)
        out = (np.cumsum(masked)[:n] > 0) | skip[line] | (index[:n] < begin[line]) if n else blank
        e, flags = np.where(out, 32, codes), np.where(out, SPACE, flags)
        gap = blank | out
        # a sentence begins behind an end mark, closing signs and white space
        last, solid = behind(~gap), behind((flags & CLOSER) == 0)
        inner = np.zeros(n, bool)
        starts = np.flatnonzero(flags & (CAPITAL | OPENER))
        starts = starts[(starts > 0)]
        starts = starts[gap[starts - 1] & (last[starts - 1] >= 0)]
        mark_at = solid[last[starts - 1]]
        fits = (mark_at >= 0) & (line[np.maximum(mark_at, 0)] == line[starts]) & ((flags[np.maximum(mark_at, 0)] & END) > 0)
        inner[starts[fits]] = True
        edge = inner | first[:n]
        segment = np.cumsum(edge) - 1
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], n)
        token = ~gap
        if n:
            token[1:] &= gap[:-1] | edge[1:]
        tokens = np.bincount(segment[token], minlength=len(heads))
        end = last[tails - 1] if len(heads) else heads
        closed = np.append(inner[heads[1:]], False) if len(heads) else np.zeros(0, bool)
        good = closed | ((end >= heads) & ((flags[np.maximum(end, 0)] & STOP) > 0)) if len(heads) else closed
        kept = (tokens >= 2) & ~((tokens < 5) & ~good)
        sentences = np.bincount(row[heads[kept]], minlength=rows)
        # a text without any sentence is one as a whole
        bare = sentences == 0
        use = kept[segment] & ~out if n else token
        if n and bare.any():
            whole = bare[row]
            e, use, flags = np.where(whole, codes, e), use | whole, np.where(whole, table[kind], flags)
            segment = np.where(whole, len(heads) + row, segment)
        self.sentences = np.maximum(sentences, 1)
        here = ((flags & LETTER) > 0) & use
        hyphen = np.zeros(n, bool)
        if n > 2:
            hyphen[1:-1] = (e[1:-1] == ord("-")) & here[:-2] & here[2:] & (segment[:-2] == segment[2:])
        inside = here | hyphen
        starts = inside.copy()
        if n:
            starts[1:] &= ~inside[:-1] | (segment[1:] != segment[:-1])
        at = np.flatnonzero(starts)
        breaks = np.append(~inside, True)
        if n:
            breaks[1:n] |= segment[1:] != segment[:-1]
        length = follow(breaks[:n])[np.minimum(at + 1, n)] - at
        low = lower[kind]
        self.clauses = np.bincount(row[((flags & CLAUSE) > 0) & use], minlength=rows)
        words = [row[at], segment[at], _hashed(low, at, length), length]
        # a text without words counts as one word that is in no list
        none = np.setdiff1d(np.arange(rows), words[0])
        if len(none):
            words = [np.concatenate([w, x]) for w, x in zip(words, (none, len(heads) + rows + none, np.zeros(len(none), np.uint64), np.ones(len(none), np.int64)))]
            order = np.argsort(words[0], kind="stable")
            words = [w[order] for w in words]
        self.row, self.segment, self.word, self.length = words

    def mean(self, value: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """The mean of a value of the words by row."""
        row = self.row if where is None else self.row[where]
        value = value if where is None else value[where]
        return np.bincount(row, value, self.rows) / np.maximum(np.bincount(row, minlength=self.rows), 1)

    def diversity(self) -> np.ndarray:
        """By row the mean share of different words in its windows."""
        with np.errstate(over="ignore"):
            key = self.word ^ (self.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        twin = np.zeros(len(order), bool)
        twin[1:] = key[order][1:] == key[order][:-1]
        before = np.full(len(order), -1)
        before[order[1:][twin[1:]]] = order[:-1][twin[1:]]
        count = np.bincount(self.row, minlength=self.rows)
        base = np.cumsum(count) - count
        last = np.maximum(count - WINDOW, 0)
        half = WINDOW // 2
        windows = last // half + 1 + (last % half > 0)
        owner = np.repeat(np.arange(self.rows), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = base[owner] + np.minimum(place * half, last[owner])
        width = np.minimum(count[owner], WINDOW)
        at = np.repeat(start, width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        new = np.bincount(np.repeat(np.arange(len(owner)), width), before[at] < np.repeat(start, width), len(owner))
        return np.bincount(owner, new / width, self.rows) / windows


def features(codes: np.ndarray, offsets: np.ndarray, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language in LANGS, features) of the rows of a flat code-point array."""
    t = Text(codes, offsets)
    rows, listed = t.rows, _listed(t.word)
    en, fr = (np.bincount(t.row[(listed & bit) > 0], minlength=rows) for bit in _FUNCTION)
    lang = (fr > en).astype(np.int64)
    own = lang[t.row]
    content = ((listed & np.array(_FUNCTION, np.uint8)[own]) == 0) & (t.length > 1)
    content |= (np.bincount(t.row[content], minlength=rows) == 0)[t.row]
    link = (listed & np.array(_CONNECTIVE, np.uint8)[own]) > 0
    # words of each sentence that has any
    number, back, size = np.unique(t.segment, return_inverse=True, return_counts=True)
    owner = np.zeros(len(number), np.int64)
    owner[back] = t.row
    order = np.lexsort((size, owner))
    count = np.bincount(owner, minlength=rows)
    base = np.cumsum(count) - count
    sorted_size = size[order].astype(float)
    median = (sorted_size[base + (count - 1) // 2] + sorted_size[base + count // 2]) / 2 if rows else np.zeros(0)
    sentence = np.bincount(owner, size, rows) / np.maximum(count, 1)
    rare = rarity.of(t.word)
    letters = t.length.astype(float)
    depth = t.clauses + np.bincount(t.row[(listed & RELATIVE) > 0], minlength=rows)
    columns = [np.log(sentence), np.log(median), np.log(t.mean(letters, content)), t.mean(letters >= 7, content), t.mean(letters >= 10, content), t.diversity(), t.mean(rare, content), t.mean(rare > -math.log(RARE), content), t.mean(link) * 10, np.log1p(depth / t.sentences)]
    return lang, np.stack(columns, 1) if rows else np.zeros((0, len(NAMES)))


class Rarity:
    """Minus the log of the share of each word in the collection; words under SHARE, and unknown ones, have that of SHARE."""

    def __init__(self, words: np.ndarray, shares: np.ndarray):
        order = np.argsort(words)
        self.words = np.append(words[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.append(-np.log(np.maximum(shares[order], SHARE)), -math.log(SHARE)).astype(np.float32)

    def of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at], -math.log(SHARE)).astype(np.float64)


def fit_ordinal(x: np.ndarray, y: np.ndarray, levels: int, l2: float = 0.3, steps: int = 3000, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model by gradient descent with momentum on the penalised likelihood."""
    n, d = x.shape
    w, theta = np.zeros(d), np.linspace(-2, 2, levels - 1)
    theta = np.concatenate([theta[:1], np.log(np.diff(theta))])  # the first and the logs of the gaps
    params, speed = np.concatenate([w, theta]), np.zeros(d + levels - 1)
    scale = np.full_like(params, 1e-8)
    for _ in range(steps):
        w, raw = params[:d], params[d:]
        cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        z = x @ w
        upper = np.concatenate([1 / (1 + np.exp(-np.clip(cuts[None, :] - z[:, None], -40, 40))), np.ones((n, 1))], 1)
        lower = np.concatenate([np.zeros((n, 1)), upper[:, :-1]], 1)
        rows = np.arange(n)
        u, lo = upper[rows, y], lower[rows, y]
        p = np.maximum(u - lo, 1e-12)
        du, dl = u * (1 - u) / p, lo * (1 - lo) / p
        gz = (du - dl) / n  # of the negative log likelihood in z
        gc = np.zeros(levels + 1)
        np.add.at(gc, y + 1, -du / n)
        np.add.at(gc, y, dl / n)
        gc = gc[1:levels]
        graw = np.concatenate([[gc.sum()], [gc[k + 1 :].sum() * np.exp(raw[1 + k]) for k in range(levels - 2)]])
        g = np.concatenate([x.T @ gz + l2 * w / n, graw])
        speed = 0.9 * speed + 0.1 * g
        scale = 0.99 * scale + 0.01 * g * g
        params = params - rate * speed / (np.sqrt(scale) + 1e-6)
    raw = params[d:]
    return params[:d], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


class Grader:
    """Models by language over the rarity of words."""

    def __init__(self, rarity: Rarity):
        self.rarity, self.models = rarity, {}

    def fit(self, graded: list[tuple[str, int]]) -> Grader:
        """Fit to (text, level) pairs; a language without graded texts of every level gets the model of all."""
        self.levels = sorted({k for _, k in graded})
        lang, every = features(*to_codes(pa.array([t for t, _ in graded], pa.string())), self.rarity)
        y = np.array([self.levels.index(k) for _, k in graded], np.int64)
        for which in [-1, *range(len(LANGS))]:
            own = lang == which if which >= 0 else np.ones(len(y), bool)
            if len(np.unique(y[own])) < len(self.levels) or not own.any():
                continue
            x = every[own]
            mean, std = x.mean(0), x.std(0) + 1e-9
            self.models[which] = (mean, std, *fit_ordinal((x - mean) / std, y[own], len(self.levels)))
        return self

    def grades(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, scores) of the rows of a flat code-point array: the score grows with difficulty, thresholds lie between the levels."""
        lang, x = features(codes, offsets, self.rarity)
        level, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        for which in range(len(LANGS)):
            own = lang == which
            mean, std, w, cuts = self.models.get(which) or self.models[-1]
            score[own] = ((x[own] - mean) / std) @ w
            level[own] = np.array(self.levels)[(score[own][:, None] > cuts[None, :]).sum(1)]
        return level, score

    def grade(self, text: str) -> tuple[int, float]:
        level, score = self.grades(*to_codes(pa.array([text], pa.string())))
        return int(level[0]), float(score[0])


def rarities(texts: DataFrame, column: str) -> Rarity:
    """The rarity of words, counted over all rows once; only words of at least a share of SHARE come to the driver."""
    found = texts.where(F.col(column).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"\p{L}+"), 0)).alias("word"))
    counts = materialize(found.groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    usual = counts.where(F.col("n") >= SHARE * total).toArrow()
    return Rarity(hashes_of(usual.column("word").to_pylist()), usual.column("n").to_numpy() / total)


def with_level(df: DataFrame, text: str, grader: Grader, least: int = 40, out: str = "level") -> DataFrame:
    """``df`` with ``level`` and ``score`` of ``text``; both null for texts that are too short to judge."""
    base = df.drop(out, "score")
    kept = [f"c{i}" for i in range(len(base.columns))]
    which = kept[base.columns.index(text)]
    source = base.toDF(*kept)
    schema = T.StructType([*source.schema.fields, T.StructField("level", T.IntegerType()), T.StructField("score", T.DoubleType())])
    names = schema.names

    def run(batches):
        flags = _classes()[0]
        for batch in batches:
            for part in slices(batch, which, PORTION):
                codes, offsets = to_codes(part.column(which))
                word = (flags[np.minimum(codes, 0x2FFFF)] & SPACE) == 0
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                begins[edges] = word[edges]
                count = np.concatenate([[0], np.cumsum(begins)])
                judged = np.diff(count[offsets]) >= least
                some = np.flatnonzero(judged)
                picked = judged[np.repeat(np.arange(part.num_rows), np.diff(offsets))]
                level, score = grader.grades(codes[picked], np.concatenate([[0], np.cumsum(np.diff(offsets)[some])]))
                levels, scores = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                levels[some], scores[some] = level, score
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(levels, pa.int32(), mask=~judged), pa.array(scores, pa.float64(), mask=~judged)], names=names)

    return source.mapInArrow(run, schema).toDF(*base.columns, out, "score")
