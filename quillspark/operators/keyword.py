"""The best texts of many queries by keywords, in one pass over the texts.

The terms of a block of queries are the rows of a matrix of bits, the texts of a chunk its
columns: a bit says whether the text has the term. The sum of a query's rows of tokens bounds
the score of each text; sequences are counted only where that bound reaches the best so far.
Each task keeps the best texts of each query, so what leaves a task grows with queries and k,
not with the pairs of query and text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of cells and of bits at most, texts at a time at most, and words whose tokens are remembered at most.
CELLS, BITS, TEXTS, WORDS = 1 << 25, 1 << 26, 32768, 300_000
#: Scores are rounded to six digits later; those nearer than this may change places by it.
MARGIN = 1.1e-6
#: So many texts or fewer are sorted as they are.
SOME = 48
#: Stands for what a text shorter than three characters lacks.
PAD = 0x110000
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
SCHEMA = "how string, query_id string, id string, tri int, n_tri int, tok int, n_tok int, same int, n_set int, phrase boolean"


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that are neither null nor empty: their bytes, where each begins and ends, and the same for code points."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return data, at, points, np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]


def words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of a-z and 0-9, and the text that each is of."""
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[at[:-1]] = inside[at[:-1]]
    where = np.flatnonzero(begins)
    kept = data[inside]
    offsets = np.append(np.cumsum(inside)[where] - 1, len(kept)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(kept)), np.searchsorted(at, where, "right") - 1


def sequences(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of three code points, and the text that each is of; a text shorter than three has one row, padded."""
    n = np.diff(at)
    of = np.repeat(np.arange(len(n)), n)
    threes = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else np.zeros(0, np.int64)
    rows = np.stack([points[threes], points[threes + 1], points[threes + 2]])
    short = np.flatnonzero(n < 3)
    if len(short):
        first = at[short]
        second = np.where(n[short] > 1, points[np.minimum(first + 1, len(points) - 1)], PAD)
        rows = np.concatenate([rows, np.stack([points[first], second, np.full(len(short), PAD)]).astype(np.uint32)], axis=1)
    return rows, np.append(of[threes], short)


class Vocabulary:
    """Three-character sequences of queries, numbered; texts are looked up in it."""

    def __init__(self, rows: np.ndarray):
        self.slot = np.zeros(PAD + 1, np.int64)
        signs = np.unique(rows)
        self.slot[signs] = np.arange(1, len(signs) + 1)
        self.base = len(signs) + 1
        keys = self._keys(rows)
        self.keys, self.numbers = np.unique(keys, return_inverse=True)
        self.table = None
        if self.base**3 <= 1 << 24:
            self.table = np.full(self.base**3, -1, np.int32)
            self.table[self.keys] = np.arange(len(self.keys))

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        a, b, c = (self.slot[r] for r in rows)
        return (a * self.base + b) * self.base + c

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The number of each sequence, or -1."""
        keys = self._keys(rows)
        if self.table is not None:
            return self.table[keys]
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)


def _runs(numbers: np.ndarray, of: np.ndarray, n: int, once: bool) -> list[np.ndarray]:
    """The numbers of each of n texts, in order and once each if that is asked."""
    base = int(numbers.max()) + 1 if len(numbers) else 1
    keys = of.astype(np.int64) * base + numbers
    if once:
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return np.split(keys % base, np.searchsorted(keys // base, np.arange(1, n)))


def held(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of the rows each column of 0 and 1 has."""
    total = np.zeros(m.shape[1], np.int32)
    for k in range(0, len(rows), 255):
        total += np.add.reduce(m[rows[k : k + 255]], axis=0, dtype=np.uint8)
    return total


class Matrix:
    """Which terms of a block of texts of queries each text of a batch has: sequences, whole words, and tokens within words."""

    def __init__(self, queries: list[str], threes: bool = True, inside: bool = False, terms: np.ndarray | None = None):
        data, at, points, places = parts(pa.array(queries, pa.string()))
        rows, of = sequences(points, places)
        self.vocabulary = Vocabulary(rows if terms is None else terms)
        self.tri = _runs(np.asarray(self.vocabulary.numbers).reshape(-1), of, len(queries), True) if terms is None else []
        tokens, whose = words(data, at)
        coded = tokens.dictionary_encode()
        self.tokens = coded.dictionary
        first = len(self.vocabulary.keys) if threes else 0
        numbers = coded.indices.to_numpy().astype(np.int64) + first
        self.tok = _runs(numbers, whose, len(queries), False)
        self.set = _runs(numbers, whose, len(queries), True)
        self.threes, self.first, self.within = threes, first, first + len(self.tokens)
        self.rows = self.within + (len(self.tokens) if inside else 0)
        self.inside = {t: k for k, t in enumerate(self.tokens.to_pylist())} if inside else None
        self.lengths = sorted({len(t) for t in self.inside or ()})
        self.known: dict[str, tuple[int, ...]] = {}
        self.texts = int(max(16, min(4096, CELLS // max(1, self.rows))) // 8 * 8)
        self.most = int(max(self.texts, min(TEXTS, 8 * BITS // max(1, self.rows)) // self.texts * self.texts))

    def _tokens_in(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            get = self.inside.get
            got = tuple({t for n in self.lengths if n <= len(word) for i in range(len(word) - n + 1) if (t := get(word[i : i + n])) is not None})
            self.known[word] = got
        return got

    def of(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        m = np.zeros(self.rows * n, np.uint8)
        data, at, points, places = parts(texts)
        if self.threes:
            rows, of = sequences(points, places)
            found = self.vocabulary.find(rows)
            hit = found >= 0
            m[found[hit].astype(np.int64) * n + of[hit]] = 1
        runs, of = words(data, at)
        coded = runs.dictionary_encode()
        which = coded.indices.to_numpy()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.tokens), -1).to_numpy(zero_copy_only=False)[which].astype(np.int64)
        hit = found >= 0
        m[(found[hit] + self.first) * n + of[hit]] = 1
        if self.inside is not None:
            some = [self._tokens_in(w) for w in coded.dictionary.to_pylist()]
            size = np.array([len(s) for s in some], np.int64)
            every = np.array([t for s in some for t in s], np.int64)
            begin = np.cumsum(size) - size
            each = size[which]
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[which], each)
            m[(every[k] + self.within) * n + np.repeat(of, each)] = 1
        return m.reshape(self.rows, n)


    def bits(self, texts: pa.Array) -> np.ndarray:
        """`of` packed: eight texts a byte, the first in the highest bit."""
        out = np.empty((self.rows, -(-len(texts) // 8)), np.uint8)
        for k in range(0, len(texts), self.texts):
            some = np.packbits(self.of(texts.slice(k, self.texts)), axis=1)
            out[:, k // 8 : k // 8 + some.shape[1]] = some
        return out


def chunks(batches, most: int):
    """``batches`` put together to chunks of ``most`` rows, the last of up to half as many more, each in the order of its ids."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        while n > most * 3 // 2:
            every = pa.Table.from_batches(kept)
            yield _by_id(every.slice(0, most).to_batches())
            kept, n = every.slice(most).to_batches(), n - most
    if n:
        yield _by_id(kept)


def _by_id(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    some = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    return some.take(pc.sort_indices(some.column("id"), null_placement="at_start"))


def _cells(bits: np.ndarray, rows: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """1 or 0 for each of some rows and some texts."""
    return bits.reshape(-1)[rows[:, None] * bits.shape[1] + (texts >> 3)] >> (7 - (texts & 7)).astype(np.uint8) & 1


class _Best:
    """The best texts of one query so far, by score and id, and all that rounding may bring among them."""

    __slots__ = ("k", "rows", "limit")

    def __init__(self, k: int, limit: float = -1.0):
        self.k, self.rows, self.limit = k, [], limit

    def add(self, rows: list[tuple]) -> None:
        every = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is not None, r[1]))
        if len(every) > self.k:
            limit, kept, score, n = every[self.k - 1][0] - MARGIN, [], None, 0
            for r in every:
                if r[0] < limit:
                    break
                n = n + 1 if r[0] == score else 1
                score = r[0]
                if n <= self.k:
                    kept.append(r)
            every = kept
        if len(every) >= self.k:
            self.limit = max(self.limit, every[self.k - 1][0] - MARGIN)
        self.rows = every


#: The matrix that this worker made last, by name.
_LAST: dict[str, Matrix] = {}


def _found(batches, queries: list[tuple], ways: dict[str, int], name: str | None = None) -> tuple[Matrix, list[dict[str, _Best]]]:
    m = _LAST.get(name)
    if m is None:
        m = Matrix([q[1] for q in queries], "lexical" in ways or "baseline" in ways, "rg" in ways)
        _LAST.clear()
        if name:
            _LAST[name] = m
    best = [{how: _Best(k, *limits) for (how, k), *limits in zip(ways.items(), *q[2:])} for q in queries]
    for some in chunks(batches, m.most):
        _met(m, some.column("id"), some.column("flat"), queries, best)
    return m, best


def limits(batches, texts: pa.RecordBatch, ways: dict[str, int]):
    """``batches(query_id, flat)`` of queries with limits: scores that texts of their k best by each of ``ways`` reach, as k of ``texts(id, flat)`` do."""
    for batch in batches:
        if batch.num_rows:
            _, best = _found([texts], list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), ways)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[x.limit for x in b.values()] for b in best], pa.list_(pa.float64()))], names=["query_id", "flat", "limits"])


def top(batches, queries: list[tuple], ways: dict[str, int], name: str | None = None):
    """Batches of `SCHEMA`: of ``batches(id, flat)``, texts in normal form, the best of each of ``queries(query_id, flat)`` by each of ``ways``, name and k.

    All those whose rounded score may be among the k highest, ties by id. Queries may have ``limits`` too.
    A worker that is given the queries by the same name again doesn't prepare them anew.
    """
    m, best = _found(batches, queries, ways, name)
    sizes = [np.array([len(x) for x in terms], np.int32) for terms in (m.tri, m.tok, m.set)]
    asked = pa.array([q[0] for q in queries], pa.string())
    names = ["how", "query_id", "id", "tri", "n_tri", "tok", "n_tok", "same", "n_set", "phrase"]
    for how in ways:
        for begin in range(0, len(queries), 1024):
            found = [b[how].rows for b in best[begin : begin + 1024]]
            of = np.repeat(np.arange(begin, begin + len(found)), [len(x) for x in found])
            if not len(of):
                continue
            _, ids, *counts, phrase = zip(*(r for x in found for r in x), strict=True)
            tri, tok, same = (pa.array(c, pa.int32()) for c in counts)
            n_tri, n_tok, n_set = (pa.array(n[of]) for n in sizes)
            yield pa.RecordBatch.from_arrays([pa.array([how] * len(of)), asked.take(pa.array(of)), pa.array(ids, pa.string()), tri, n_tri, tok, n_tok, same, n_set, pa.array(phrase, pa.bool_())], names=names)


def _least(how: str, limit: float, n_tok: int, n_set: int) -> int:
    """Different tokens that a text has at least if its score reaches the limit.

    A text that holds the query has all its words but, within longer ones, the first and the last.
    """
    if how == "baseline":
        least = limit / 0.8 * n_set
    else:
        least = ((limit - 0.55) / 0.35 if how == "lexical" else limit) * n_tok - (n_tok - n_set)
    return max(0, min(math.ceil(least - 1e-6), n_set - 2 if how != "rg" else n_set))


def _met(m: Matrix, ids: pa.Array, texts: pa.Array, queries: list[tuple], best: list[dict[str, _Best]]) -> None:
    bits, n = m.bits(texts), len(texts)
    common = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    names = ids.to_pylist()
    for q, (_, flat, *_) in enumerate(queries):
        for inside in (False, True):
            ways = {how: b for how, b in best[q].items() if (how == "rg") == inside}
            if not ways:
                continue
            n_tok, n_set = len(m.tok[q]), len(m.set[q])
            if not n_set or n_set > 255 or len(flat) < 3:
                _score(m, bits, texts, names, q, flat, np.arange(n), None, ways)
                continue
            rows = m.set[q] + (m.within - m.first) * inside
            least = min(_least(how, b.limit, n_tok, n_set) for how, b in ways.items())
            often = min(3, least)
            if often and 3 * (n_set - least) < 2 * n_set:
                # a text that lacks so many of the rarest ones has too few
                rare = rows[np.argsort(common[rows])[: n_set - least + often]]
                some = np.flatnonzero(np.unpackbits(_often(bits, rare.tolist(), often), count=n).view(bool))
                if len(some) * 8 < n:
                    shared = np.add.reduce(_cells(bits, rows, some), axis=0, dtype=np.uint8)
                    kept = np.flatnonzero(shared >= least)
                    _score(m, bits, texts, names, q, flat, some[kept], shared[kept], ways)
                    continue
            shared = np.add.reduce(np.unpackbits(bits[rows], axis=1, count=n), axis=0, dtype=np.uint8)
            first = 256
            if any(b.limit < 0 for b in ways.values()):
                # those with most tokens first, so that there is a limit for the others
                most = np.cumsum(np.bincount(shared, minlength=n_set + 1)[::-1])
                first = n_set - int(np.searchsorted(most, 2 * max(b.k for b in ways.values())))
                some = np.flatnonzero(shared >= max(0, first))
                _score(m, bits, texts, names, q, flat, some, shared[some], ways)
                least = min(_least(how, b.limit, n_tok, n_set) for how, b in ways.items())
            if least < first:
                some = np.flatnonzero((shared >= least) & (shared < first))
                _score(m, bits, texts, names, q, flat, some, shared[some], ways)


def _often(bits: np.ndarray, rows: list[int], often: int) -> np.ndarray:
    """Which texts have at least ``often`` of some rows, as bits."""
    have = [np.zeros(bits.shape[1], np.uint8) for _ in range(often)]
    for row in rows:
        for k in range(often - 1, 0, -1):
            have[k] |= have[k - 1] & bits[row]
        have[0] |= bits[row]
    return have[-1]


def _score(m: Matrix, bits: np.ndarray, texts: pa.Array, names: list, q: int, flat: str, some: np.ndarray, shared: np.ndarray | None, ways: dict[str, _Best]) -> None:
    """Some texts, in the order of their ids, are scored for a query, and the best of them kept; shared: how many different tokens they have."""
    for k in range(0, len(some), 4096):
        _scored(m, bits, texts, names, q, flat, some[k : k + 4096], None if shared is None else shared[k : k + 4096].astype(np.int32), ways)


def _scored(m: Matrix, bits: np.ndarray, texts: pa.Array, names: list, q: int, flat: str, some: np.ndarray, shared: np.ndarray | None, ways: dict[str, _Best]) -> None:
    n_tri, n_tok, n_set = len(m.tri[q]), len(m.tok[q]), len(m.set[q])
    zero = np.zeros(len(some), np.int32)
    count = lambda rows: np.add.reduce(_cells(bits, rows, some), axis=0, dtype=np.int32) if len(rows) else zero
    if "rg" in ways:
        tri = same = zero
        tok, phrase = shared, np.zeros(len(some), bool)
        if shared is None or n_tok != n_set:
            tok = count(m.tok[q] - m.first + m.within)
    else:
        same = count(m.set[q]) if shared is None else shared
        tok = same if n_tok == n_set else count(m.tok[q])
        if "lexical" in ways:
            tri = count(m.tri[q])
        else:
            near, tri = np.flatnonzero(same >= n_set - 2), np.zeros(len(some), np.int32)
            tri[near] = np.add.reduce(_cells(bits, m.tri[q], some[near]), axis=0, dtype=np.int32)
        whole = np.flatnonzero(tri == n_tri)
        if len(flat) < 3:
            whole = np.union1d(whole, np.flatnonzero(same > 0))
        phrase = np.zeros(len(some), bool)
        for k in whole:
            phrase[k] = flat in texts[int(some[k])].as_py()
    for how, b in ways.items():
        if how == "rg":
            ok, score = tok > 0, tok / max(1, n_tok)
        elif how == "baseline":
            ok, score = (same > 0) | phrase, 0.8 * (same / max(1, n_set)) + 0.2 * phrase
        else:
            ok, score = (tok > 0) | (tri == n_tri), 0.55 * (tri / max(1, n_tri)) + 0.35 * (tok / max(1, n_tok)) + 0.10 * phrase
        good = np.flatnonzero(ok & (score >= b.limit))
        if len(good) > max(b.k, SOME):
            limit = np.partition(score[good], -b.k)[-b.k] - MARGIN
            good = good[score[good] >= limit]
        if len(good) > max(b.k, SOME):  # of equal scores the first k by id; texts are in the order of their ids
            good = good[np.argsort(-score[good], kind="stable")]
            fresh = np.append(True, score[good[1:]] != score[good[:-1]])
            since = np.arange(len(good)) - np.maximum.accumulate(np.where(fresh, np.arange(len(good)), 0))
            good = good[since < b.k]
        if len(good):
            b.add([(x, names[i], t, w, e, f) for x, i, t, w, e, f in zip(score[good].tolist(), some[good].tolist(), tri[good].tolist(), tok[good].tolist(), same[good].tolist(), phrase[good].tolist(), strict=True)])


def having(batches, plans: list[tuple[str, str, list[list[str]]]]):
    """(query_id, id, text, pattern) of ``batches(id, text, flat)``: texts that have all sequences of one alternative of ``plans(query_id, pattern, alternatives)``."""
    of = lambda ts: sequences(*parts(pa.array(ts, pa.string()))[2:])[0]
    m = Matrix([], terms=of([t for _, _, some in plans for a in some for t in a]))
    asked = [[np.unique(m.vocabulary.find(of(a))) for a in some] for _, _, some in plans]
    names = ["query_id", "id", "text", "pattern"]
    for some in chunks(batches, m.most):
        bits, n = m.bits(some.column("flat")), some.num_rows
        common = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for (name, pattern, _), sets in zip(plans, asked, strict=True):
            have = np.zeros(bits.shape[1], np.uint8)
            for rows in sets:
                # the rarest sequences leave few texts to the others
                rare = rows[np.argsort(common[rows])]
                left = np.bitwise_and.reduce(bits[rare[:6]], axis=0)
                if left.any():
                    have |= np.bitwise_and.reduce(bits[rare], axis=0, out=left) if len(rare) > 6 else left
            if not have.any():
                continue
            which = some.take(pa.array(np.flatnonzero(np.unpackbits(have, count=n))))
            if which.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([name] * which.num_rows, pa.string()), which.column("id"), which.column("text"), pa.array([pattern] * which.num_rows, pa.string())], names=names)
