"""Personal information in free text (problem 2).

A linear-chain conditional random field labels tokens as part of an e-mail address, a
telephone number, an identity number, a street address, a name, or none. It is trained, when
first used, on the small table of `pii_table`. The features are of the words around a token:
their shapes, endings, whether they touch, and those words that the table has often. Every
feature weighs by its distance, so a token type has one row of scores per distance, and the
scores of a batch are sums of gathered rows. Decoding is Viterbi in numpy over all open
stretches of a batch at once; a token whose best possible score for any label stays under that of
"none", whatever its neighbours are, ends a stretch, which leaves the best labelling as it is.

A last check of a found stretch drops what can't be a mention of its type (an e-mail address
without a sign for "at", a telephone number of under seven digits) and moves its start onto
the first character that belongs to it. Null and blank texts have no mentions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_table
from .chain import viterbi
from .codepoints import pieces, slices, to_codes
from .unify import _tables

LABELS = ["O", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
REACH = 4
#: Bytes of text that are labelled at once.
PORTION = 1 << 22
_WORD = re.compile(r"^[^\W\d_]")


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point its plain twin, and 0 white space, 1 letter, 2 digit, 3 other."""
    import unicodedata

    fold, _, ccc, *_ = _tables()
    fold = fold.copy()
    fold[fold == ord("’")] = ord("'")
    kind = np.full(len(fold), 3, np.uint8)
    for c in range(len(fold)):
        ch = chr(c)
        if ch.isspace():
            kind[c] = 0
        elif ch.isdigit() and unicodedata.category(ch) == "Nd":
            kind[c] = 2
        elif ch.isalpha() or ccc[c]:
            kind[c] = 1
    return fold, kind[np.minimum(fold, len(fold) - 1)]


class Tokens:
    """The tokens of a batch of texts: runs of letters, runs of digits, single other characters."""

    def __init__(self, column: pa.Array):
        self.codes, self.offsets = to_codes(column)
        fold, kinds = _kinds()
        small = np.minimum(self.codes, len(fold) - 1)
        self.plain = np.where(self.codes < len(fold), fold[small], self.codes).astype(np.uint32)
        kind = np.where(self.codes < len(fold), kinds[small], 3)
        n = len(self.codes)
        edge = np.ones(n + 1, bool)
        if n:
            edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        edge[self.offsets] = True
        bounds = np.flatnonzero(edge)
        part_kind = kind[bounds[:-1]] if n else np.zeros(0, np.uint8)
        solid = np.flatnonzero(part_kind > 0)
        self.start, self.end = bounds[:-1][solid], bounds[1:][solid]
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        first = np.ones(len(solid), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        lines = np.zeros(n + 1, np.int32)
        np.cumsum(self.plain == 10, out=lines[1:])
        crossed = np.zeros(len(solid), np.int32)
        crossed[1:] = lines[self.start[1:]] - lines[self.end[:-1]]
        glued = np.zeros(len(solid), bool)
        glued[1:] = self.start[1:] == self.end[:-1]
        opens = first | (crossed > 1)
        self.sequence = np.cumsum(opens) - 1 if len(solid) else np.zeros(0, np.int64)
        masked = np.where(kind == 2, np.uint32(48), self.plain).astype("<u4")
        width = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (masked >= 0x80).astype(np.int8) + (masked >= 0x800) + (masked >= 0x10000), out=width[1:])
        data = np.frombuffer(masked.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        coded = pieces(data, width[bounds]).dictionary_encode()
        self.strings = coded.dictionary.to_pylist()
        flags = (glued & ~opens).astype(np.int64) + 2 * ((crossed == 1) & ~opens)
        self.types = coded.indices.to_numpy()[solid].astype(np.int64) * 4 + flags


def shape(s: str) -> str:
    if s[0] == "0":
        return "0" * min(len(s), 9)
    if not _WORD.match(s):
        return s
    if s.islower():
        return "x" if len(s) == 1 else "xx"
    if s.isupper():
        return "X" if len(s) == 1 else "XX" if len(s) < 20 else "XXX"
    return "Xx" if s[1:].islower() else "xX"


def features(s: str, glued: bool, broken: bool) -> list[str]:
    """Names of the features of a token type."""
    sh = shape(s)
    out = ["", f"s{sh}", f"g{sh}{int(glued)}"]
    if broken:
        out.append("nl")
    if sh[0] in "xX":
        low = s.lower()
        out += [f"w{low}", f"W{low}{sh}", f"l{min(len(s), 6)}{sh}"]
        if len(s) > 4:
            out += [f"e{low[-4:]}{sh[0]}", f"e{low[-3:]}{sh[0]}", f"E{low[-5:]}{sh[0]}"]
    return out


class Tagger:
    """Weights of the field and what is known of token types so far."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.names, self.weights, self.transitions = names, weights, transitions
        self._rows: dict = {}
        self._table = np.zeros((1024, 2 * REACH + 1, len(LABELS)), np.float32)
        self._table[0] = weights[names["<edge>"]]
        self._used = 1

    def __getstate__(self):
        return self.names, self.weights, self.transitions

    def __setstate__(self, state):
        self.__init__(*state)

    def rows(self, tokens: Tokens) -> np.ndarray:
        """The row of the score table for each token."""
        values, inverse = np.unique(tokens.types, return_inverse=True)
        if self._used + len(values) > 400_000:
            self._rows, self._used = {}, 1
        index = np.empty(len(values), np.int64)
        for k, v in enumerate(values.tolist()):
            key = (tokens.strings[v >> 2], v & 3)
            row = self._rows.get(key)
            if row is None:
                row = self._used
                self._used += 1
                if row == len(self._table):
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                known = [self.names[f] for f in features(key[0], bool(v & 1), bool(v & 2)) if f in self.names]
                self._table[row] = self.weights[known].sum(0)
                self._rows[key] = row
            index[k] = row
        return index[inverse]

    def labels(self, tokens: Tokens) -> np.ndarray:
        """The best labelling of all sequences of a batch."""
        n = len(tokens.types)
        best = np.zeros(n, np.int8)
        if not n:
            return best
        place = np.arange(n) + REACH * (tokens.sequence + 1)
        rows = np.zeros(place[-1] + REACH + 1, np.int64)
        rows[place] = self.rows(tokens)
        table, t = self._table[: self._used], self.transitions
        lead = (table[:, :, 1:] - table[:, :, :1]).max(2)
        gain = np.zeros(n, np.float32)
        for d in range(-REACH, REACH + 1):
            gain += lead[rows[place + d], d + REACH]
        # the most that two transitions can add to a token's lead over "none": by whether its neighbours may be other than "none"
        into, out = (t - t[:, :1])[:, 1:], (t - t[:1])[1:]
        none = [(0, 0), (0, 1), (1, 0), (1, 1)]
        most = {ab: float(((into.max(0) if ab[0] else into[0]) + (out.max(1) if ab[1] else out[:, 0])).max()) for ab in none}
        # a neighbour that turns "none" may itself lose what it gained beside this token, so it is only trusted when it can't be anything else
        first = np.ones(n, bool)
        first[1:] = tokens.sequence[1:] != tokens.sequence[:-1]
        open_ = gain + most[1, 1] > 0
        for _ in range(3):
            before = np.zeros(n, bool)
            before[1:] = open_[:-1] & ~first[1:]
            after = np.zeros(n, bool)
            after[:-1] = open_[1:] & ~first[1:]
            limit = np.where(before, np.where(after, most[1, 1], most[1, 0]), np.where(after, most[0, 1], most[0, 0]))
            narrower = open_ & (gain + limit > 0)
            if (narrower == open_).all():
                break
            open_ = narrower
        at = np.flatnonzero(open_)
        if not len(at):
            return best
        score = np.zeros((len(at), len(LABELS)), np.float32)
        for d in range(-REACH, REACH + 1):
            score += table[rows[place[at] + d], d + REACH]
        opens = np.ones(len(at), bool)
        opens[1:] = (np.diff(at) > 1) | first[at[1:]]
        begin = np.flatnonzero(opens)
        length = np.diff(np.append(begin, len(at)))
        best[at] = viterbi(score, begin, length, t, t[0], t[:, 0])
        return best


def _labelled(rows: list[str]) -> tuple[Tokens, np.ndarray]:
    """Tokens of marked sentences and the number of each token's label."""
    texts, marks = [], []
    for row in rows:
        text, spans, last = "", [], 0
        for m in re.finditer(r"\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME) ((?:[^\[\]]|\[at\]|\[dot\])*)\]", row):
            text += row[last : m.start()]
            spans.append((len(text), len(text) + len(m[2]), LABELS.index(m[1])))
            text += m[2]
            last = m.end()
        texts.append(text + row[last:])
        marks.append(spans)
    tokens = Tokens(pa.array(texts))
    by_code = np.zeros(len(tokens.codes), np.int8)
    for k, spans in enumerate(marks):
        for a, b, label in spans:
            by_code[tokens.offsets[k] + a : tokens.offsets[k] + b] = label
    return tokens, by_code[tokens.start]


def train(rows: list[str], rounds: int = 8, portion: int = 96, l2: float = 2e-4, seed: int = 1) -> Tagger:
    """A tagger fitted to labelled sentences by adaptive gradient steps on the conditional likelihood."""
    tokens, gold = _labelled(rows)
    n_labels, width = len(LABELS), 2 * REACH + 1
    values, inverse = np.unique(tokens.types, return_inverse=True)
    counts: dict[str, int] = {}
    listed = [features(tokens.strings[v >> 2], bool(v & 1), bool(v & 2)) for v in values.tolist()]
    weight = np.bincount(inverse, minlength=len(values))
    for fs, c in zip(listed, weight.tolist()):
        for f in fs:
            counts[f] = counts.get(f, 0) + c
    names = {"<edge>": 0}
    for f, c in counts.items():
        if c >= 6:
            names[f] = len(names)
    flat = np.array([names[f] for fs in listed for f in fs if f in names])
    sizes = np.array([sum(f in names for f in fs) for fs in listed])
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w = np.zeros((len(names), width * n_labels), np.float32)
    t = np.zeros((n_labels, n_labels))
    gw, gt = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    rng = np.random.default_rng(seed)
    begin = np.flatnonzero(np.append(True, tokens.sequence[1:] != tokens.sequence[:-1]))
    length = np.diff(np.append(begin, len(gold)))
    for r in range(rounds):
        order = rng.permutation(len(begin))
        for p in range(0, len(order), portion):
            some = order[p : p + portion]
            some = some[np.argsort(length[some])]
            deep, many = int(length[some].max()), len(some)
            at = begin[some][:, None] + np.arange(-REACH, deep + REACH)
            inside = (at >= begin[some][:, None]) & (at < (begin + length)[some][:, None])
            types = np.where(inside, inverse[np.where(inside, at, 0)] + 1, 0)
            used, local = np.unique(types, return_inverse=True)
            local = local.reshape(types.shape)
            real = used[used > 0] - 1
            rows_of = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in real]) if len(real) else np.zeros(0, np.int64)
            pos = np.searchsorted(used, owner[rows_of] + 1)
            table = np.zeros((len(used), width * n_labels), np.float32)
            np.add.at(table, pos, w[flat[rows_of]])
            if used[0] == 0:
                table[0] = w[0]
            cube = table.reshape(len(used), width, n_labels)
            e = np.zeros((many, deep, n_labels))
            for d in range(width):
                e += cube[local[:, d : d + deep], d]
            mask = inside[:, REACH : REACH + deep]
            truth = np.where(mask, gold[np.where(mask, at[:, REACH : REACH + deep], 0)], 0)
            e[~mask] = -1e4
            e[~mask, 0] = 0
            alpha = np.zeros((many, deep, n_labels))
            beta = np.zeros((many, deep, n_labels))
            alpha[:, 0] = t[0] + e[:, 0]
            for k in range(1, deep):
                x = alpha[:, k - 1, :, None] + t
                top = x.max(1, keepdims=True)
                alpha[:, k] = np.log(np.exp(x - top).sum(1)) + top[:, 0] + e[:, k]
            beta[:, -1] = t[:, 0]
            for k in range(deep - 2, -1, -1):
                x = t + (e[:, k + 1] + beta[:, k + 1])[:, None, :]
                top = x.max(2, keepdims=True)
                beta[:, k] = np.log(np.exp(x - top).sum(2)) + top[:, :, 0]
            z = alpha[:, -1] + t[:, 0]
            top = z.max(1, keepdims=True)
            z = np.log(np.exp(z - top).sum(1)) + top[:, 0]
            marginal = np.exp(alpha + beta - z[:, None, None])
            marginal[~mask] = 0
            de = marginal.copy()
            k = np.nonzero(mask)
            de[k[0], k[1], truth[k]] -= 1
            dt = np.zeros_like(t)
            for j in range(1, deep):
                both = alpha[:, j - 1, :, None] + t + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None]
                live = mask[:, j]
                dt += np.exp(both[live]).sum(0)
                np.add.at(dt, (truth[live, j - 1], truth[live, j]), -1)
            dt[0] += marginal[:, 0].sum(0)
            np.add.at(dt[0], truth[:, 0], -1)
            last = np.minimum(length[some], deep) - 1
            dt[:, 0] += marginal[np.arange(many), last].sum(0)
            np.add.at(dt[:, 0], truth[np.arange(many), last], -1)
            dtable = np.zeros((len(used), width, n_labels), np.float32)
            for d in range(width):
                np.add.at(dtable[:, d], local[:, d : d + deep][mask], de[mask].astype(np.float32))
            dtable = dtable.reshape(len(used), -1)
            touched, where = np.unique(flat[rows_of], return_inverse=True)
            dw = np.zeros((len(touched), dtable.shape[1]), np.float32)
            np.add.at(dw, where, dtable[pos])
            if used[0] == 0:
                g = dtable[0] / many + l2 * w[0]
                gw[0] += g * g
                w[0] -= 0.25 * g / np.sqrt(gw[0])
            g = dw / many + l2 * w[touched]
            gw[touched] += g * g
            w[touched] -= 0.25 * g / np.sqrt(gw[touched])
            g = dt / many + l2 * t
            gt += g * g
            t -= 0.25 * g / np.sqrt(gt)
    return Tagger(names, w.reshape(len(names), width, n_labels), t.astype(np.float32))


@lru_cache(2)
def tagger(copies: int = 14) -> Tagger:
    """The tagger trained on the labelled table, ``copies`` fillings of each of its patterns."""
    return train(pii_table.rows(copies))


# Titles before names, and words for parts of a building before addresses.
TITLES = re.compile(r"^(?:(?:mr|mrs|ms|miss|dr|prof|mme|mlle|m|me|mm|sir|monsieur|madame|maître|herr|frau)\b\.?\s*)+(?=\S)", re.I)
PARTS = re.compile(r"^(?:flat|unit|appt?|apt|apartment|appartement|suite|room|bât|bat|bâtiment|building|résidence|étage|floor|esc|escalier|porte)\b\.?[^,\n]{0,24},\s*", re.I)
#: Numbers that are grouped in thousands or have a decimal part.
AMOUNT = re.compile(r"[1-9]\d{0,2}(?:[ .]\d{3})+(?:[.,]\d{1,2})?|\d+\.\d+")
AT_SIGN = re.compile(r"@|[(\[{]\s*(?:at|arobase|chez)\s*[)\]}]|\sat\s", re.I)


def checked(label: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The mention in ``text[start:end]`` with its true start, or None; ``text`` is in plain characters."""
    if label == "EMAIL":
        m = AT_SIGN.search(text, start, end)
        if not m:
            return None
        local = re.search(r"[\w.+%'-]+\s*$", text[max(0, m.start() - 64) : m.start()])
        if not local:
            return None
        start = max(0, m.start() - 64) + local.start()
        start += len(re.match(r"(?:mailto:)?[.'-]*", text[start:end], re.I)[0])
        return (start, end) if re.search(r"\w\s*(?:\.|[(\[{]?\s*(?:dot|point)\s*[)\]}]?)\s*\w", text[m.end() : end], re.I) else None
    span = text[start:end]
    if label == "PHONE":
        start += len(re.match(r"[^\d+(]*", span)[0])
        end = start + len(re.match(r"(?:[\d\s.+()/-]|(?:ext|x|poste)\b\.?(?=\s*\d))*", text[start:end], re.I)[0])
        end -= len(text[start:end]) - len(text[start:end].rstrip(" \n.(-/"))
        if AMOUNT.fullmatch(text[start:end]) or (start and text[start - 1] in "$€£") or text[end : end + 2].strip()[:1] in ("€", "$", "%", "°") or re.match(r",\d", text[end : end + 2]):
            return None
        if start and text[start - 1] == "(" and ")" in text[start:end]:
            start -= 1
        if start and text[start - 1] == "+":
            start -= 1
        digits = sum(c.isdigit() for c in re.split(r"\s*(?:ext|x|poste)", text[start:end], flags=re.I)[0])
        return (start, end) if 7 <= digits <= 15 else None
    if label == "ID_NUMBER":
        m = re.search(r"(?<![^\s(:])(?:(?:[A-Z]{1,2}|\d{1,4})[ \n])+$", text[max(0, start - 30) : start])
        start -= len(m[0]) if m else 0
        while start and (text[start - 1].isalnum() or (text[start - 1] in "-/" and start > 1 and text[start - 2].isalnum())):
            start -= 1
        start += len(re.match(r"[\W_]*", text[start:end])[0])
        m = AMOUNT.match(text, start, end)
        if m and not text[m.end() : m.end() + 3].strip()[:1].isdigit():
            return None
        return (start, end) if sum(c.isdigit() for c in text[start:end]) >= 5 else None
    if label == "ADDRESS":
        start += len(re.match(r"[\W_]*", span)[0])
        m = PARTS.match(text, start, end)
        start = m.end() if m else start
        return (start, end) if re.search(r"[^\W\d_]{3}", text[start:end]) and re.search(r"\d", text[start:end]) else None
    start += len(re.match(r"[\W\d_]*", span)[0])
    m = TITLES.match(text[start:end])
    start += m.end() if m else 0
    while end > start and not text[end - 1].isalpha():
        end -= 1
    return (start, end) if end - start > 1 and text[start].isupper() else None


def find(model: Tagger, column: pa.Array):
    """(row, label, start, end) of each mention of an Arrow string column, offsets in code points."""
    tokens = Tokens(column)
    labels = model.labels(tokens)
    hit = np.flatnonzero(labels)
    if not len(hit):
        return
    opens = np.ones(len(hit), bool)
    opens[1:] = (np.diff(hit) > 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (tokens.sequence[hit[1:]] != tokens.sequence[hit[:-1]])
    begin = np.flatnonzero(opens)
    close = np.append(begin[1:], len(hit)) - 1
    rows = tokens.row[hit[begin]]
    current, text = -1, ""
    for row, label, a, b in zip(rows.tolist(), labels[hit[begin]].tolist(), tokens.start[hit[begin]].tolist(), tokens.end[hit[close]].tolist()):
        base = int(tokens.offsets[row])
        if row != current:
            current, text = row, tokens.plain[base : int(tokens.offsets[row + 1])].astype("<u4").tobytes().decode("utf-32-le")
        span = checked(LABELS[label], text, a - base, b - base)
        if span:
            yield row, LABELS[label], *span


def mentions(df: DataFrame, text: str) -> DataFrame:
    """One row per mention in ``text``: the other columns, entity_type, start_pos, end_pos.

    Offsets are code points of the stored text from 0, the end exclusive. Columns with those
    names are replaced, ``text`` is left out.
    """
    model = tagger()
    added = ["entity_type", "start_pos", "end_pos"]
    others = [c for c in df.columns if c not in (*added, text)]
    kept = [f"c{i}" for i in range(len(others))]
    source = df.where(F.col(text).isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(others, kept)], F.col(text).alias("t"))
    schema = T.StructType([*source.select(*kept).schema.fields, T.StructField("entity_type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", PORTION):
                found = list(find(model, part.column("t")))
                rows = part.select(kept).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())], names=names)

    return source.mapInArrow(run, schema).toDF(*others, *added)


def with_placeholders(df: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``df`` with the column ``out``: ``text`` with each mention replaced by ``[TYPE]``, all else unchanged."""
    model = tagger()
    base = df.drop(out)
    kept = [f"c{i}" for i in range(len(base.columns))]
    which = kept[base.columns.index(text)]
    source = base.toDF(*kept)
    schema = T.StructType([*source.schema.fields, T.StructField("redacted", T.StringType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, which, PORTION):
                texts = part.column(which).to_pylist()
                edits: dict[int, list] = {}
                for row, label, a, b in find(model, part.column(which)):
                    edits.setdefault(row, []).append((a, b, label))
                for row, spans in edits.items():
                    t, last, got = texts[row], 0, []
                    for a, b, label in sorted(spans):
                        if a >= last:
                            got += [t[last:a], f"[{label}]"]
                            last = b
                    texts[row] = "".join(got) + t[last:]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return source.mapInArrow(run, schema).toDF(*base.columns, out)
