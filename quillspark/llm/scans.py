"""Repair of text from scanned pages (problem 4).

The lines of a document are labelled header, page number, body or break (the first line of a
paragraph) by a hidden Markov model. What it observes of a line: its place on the page,
whether a line like it stands at the top of other pages, whether it is a number that can be
the page's, how it begins, and whether the line before could go on. Its tables are counted on
a small set of pages that `sample_pages` composes. Likeness of lines is equality of their
skeletons, in which characters that scanning confuses are one.

Words are checked against the words of the whole collection: a word that is rare, and turns
into one at least `RATIO` times as frequent when one or two usual confusions are undone, was
misread. A word divided at a line end is joined if the joined word is known and not rather a
compound or code divided at a hyphen of its own. Paragraphs are put together again from body
lines, over page breaks too.

Null and empty contents have no lines. A text whose layout isn't given, or differs from it,
is taken by itself, its pages ending at lines that can only be page numbers.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .chain import viterbi
from .unify import INVISIBLE, LOOK_ALIKES

STATES = ["header", "page_no", "body", "break"]
#: A word is rare below this count, however large the collection is.
LEAST = 3
#: A misread word's true word is at least RATIO times as frequent, and has at least SEEN occurrences.
RATIO, SEEN = 20, 5
# What scanning makes of characters, read -> true.
CONFUSIONS = [("c", "e"), ("u", "a"), ("f", "t"), ("l", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("v", "u"), ("q", "g"), ("6", "é"), ("5", "s"), ("cl", "d"), ("rn", "m"), ("m", "rn"), ("8", "b"), ("9", "g"), ("n", "ri"), ("rm", "nn"), ("li", "h"), ("d", "cl"), ("vv", "w"), ("ii", "u"), ("é", "6"), ("6", "b"), ("i", "l"), ("|", "l"), ("!", "l"), ("€", "e")]
HYPHENS = "-‐‑­¬"
_SKELETON = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "c": "e", "é": "e", "6": "e", "v": "u", "a": "u", "q": "g", "9": "g", "f": "t", "8": "b"})
_CLEAN = str.maketrans({a: b for a, b in LOOK_ALIKES.items() if b != "\n"} | {chr(c): None for c in INVISIBLE})
_PART = re.compile(r"[^\W\d_](?:[^\W_]|[|!€])*|\d[^\W_]*")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_PAGE = re.compile(r"[\[(–—~-]*\s*(?:(?:p\s?\.?|pp\.?|pa[gq][ec]|p a[gq][ec]|pg\.?|page no\.?|seite|folio|f°)\s*)?([\dlIoO]{1,5}|[ivxlcdm]{1,8})\s*(?:(?:of|sur|de|von|/)\s*([\dlIoO]{1,5}))?\s*[\])–—~-]*", re.I)


def page_value(line: str) -> tuple[int, int | None, bool] | None:
    """(page, pages or None, written so that it can't be anything else) of a line with only a page's number."""
    m = _PAGE.fullmatch(line.strip())
    if not m:
        return None

    def number(s: str) -> int | None:
        digits = s.translate(str.maketrans("lIoO", "1100"))
        return int(digits) if digits.isdigit() else None

    value = number(m[1]) if any(c.isdigit() for c in m[1]) or (m[2] and m[1] in ("l", "I", "ll", "lI")) or re.match(r"\W*p", line, re.I) else None
    if value is None:
        low = m[1].lower()
        if not low or not _ROMAN.fullmatch(low):
            return None
        each = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in low]
        value = sum(-a if a < b else a for a, b in zip(each, [*each[1:], 0]))
    return value, number(m[2]) if m[2] else None, bool(m[2]) or bool(re.match(r"\W*p|[\[(–—-]\s*\S", line.strip(), re.I))


@lru_cache(200_000)
def skeleton(line: str) -> str:
    """What a header line is known by on other pages: without page numbers at its ends, confusable characters as one."""
    low = re.sub(r"^\s*\[?\d{1,4}\]?\s{2,}|\s{2,}\[?\d{1,4}\]?\s*$", "", line).lower().replace("rn", "m").replace("cl", "d")
    return "".join(c for c in low.translate(_SKELETON) if c.isalnum())


class Page:
    """Lines of a page: (element, line in it, text, whether the element is running text)."""

    def __init__(self, elements: list[tuple[int, str, bool]]):
        self.contents: dict[int, str] = {}
        for e, content, _ in elements:
            self.contents[e] = f"{self.contents[e]}\n{content}" if e in self.contents else content
        self.lines = [(e, j, line.rstrip("\r"), text) for e, content, text in elements for j, line in enumerate(content.split("\n"))]


#: Sizes of the observed features.
SIZES = [4, 4, 4, 3, 3, 2]


def observe(pages: list[Page]) -> list[tuple[int, ...]]:
    """The features of each line of running text, in order."""
    tops: dict[str, int] = {}
    heads, tails = [], []
    for page in pages:
        lines = [x for x in page.lines if x[3] and x[2].strip()]
        first = {e for e, *_ in lines[:1]}
        heads.append(first)
        tails.append({lines[-1][0]} if lines and lines[-1][1] == 0 else set())
        for key in {skeleton(line) for e, j, line, _ in lines if e in first and j < 3}:
            if len(key) > 3:
                tops[key] = tops.get(key, 0) + 1
    shifts: dict[int, int] = {}
    for n, (page, tail) in enumerate(zip(pages, tails), 1):
        for e, j, line, text in page.lines:
            if e in tail and (v := page_value(line)):
                shifts[v[0] - n] = shifts.get(v[0] - n, 0) + 1
    out, prior = [], ""
    for n, (page, head, tail) in enumerate(zip(pages, heads, tails), 1):
        for e, j, line, text in page.lines:
            if not text:
                prior = ""
                continue
            s = line.strip()
            place = 0 if e in head and j < 3 else 1 if e in tail else 2 if e in head else 3
            same = tops.get(skeleton(line), 0) if place == 0 else 0
            again = 0 if same < 2 else 3 if same * 2 >= len(pages) else 2 if same > 2 else 1
            v = page_value(s) if len(s) < 24 else None
            number = 0 if v is None else 3 if shifts.get(v[0] - n, 0) > 1 or (v[1] == len(pages)) or v[0] == n else 2 if v[2] else 1
            begins = 0 if s[:1].islower() else 1 if s[:1].isupper() or not s else 2
            goes_on = 0 if not prior else 1 if prior[-1] in ".!?:|>}\"" else 2
            out.append((place, again, number, begins, goes_on, int(j == 0)))
            if s and not (again or number >= 2):
                prior = s
    return out


def sample_pages(copies: int = 60, seed: int = 3) -> list[tuple[list[Page], list[str]]]:
    """Composed documents with the label of each line."""
    r = random.Random(seed)
    words = "the any each this contract invoice pump delivery records limits before under clause le la chaque contrat facture limite avant selon article notice annual mensuel terminal of and et sous days jours units unités".split()
    out = []
    for _ in range(copies):
        n = r.randint(1, 9)
        head = None if r.random() < 0.25 else [" ".join(r.choice(words).title() for _ in range(r.randint(2, 4))) + r.choice([" | 12 May 2024", " – pump REF-7K2", " Ltd"])] + (["Notice REF-88X"] if r.random() < 0.4 else [])
        style = r.choice(["", "[{}]", "- {} -", "{}", "p. {}", "Page {} of {n}", "{}/{n}", "roman"])
        shift, bare = r.choice([0, 0, 0, 3, 14]), r.random() < 0.5
        pages, labels, carry, prior = [], [], 0, False
        for p in range(1, n + 1):
            elements: list[tuple[int, str, bool]] = []
            if head and not (p == 1 and bare):
                elements.append((len(elements), "\n".join(f"{p + shift}   {h}" if k == 0 and r.random() < 0.25 else h for k, h in enumerate(head)), True))
                labels += ["header"] * len(head)
            for _ in range(r.randint(2, 6)):
                kind = r.random()
                if kind < 0.12:
                    elements.append((len(elements), "<table>", False))
                    continue
                if kind < 0.2 and not carry:
                    elements.append((len(elements), f"Lot\n{r.randint(1, 99)}\nItem\n{r.randint(1, 99)}", True))
                    labels += ["break", "body", "body", "body"]
                    continue
                if kind < 0.35 and not carry:
                    elements.append((len(elements), r.choice(["# Annual notice REF-1", "Reference P00-1: annual pump", "- item one", "Call 020 7946 0000 before 3 May."]), True))
                    labels.append("break")
                    continue
                size = r.randint(1, 6)
                made = []
                for k in range(size):
                    line = " ".join(r.choice(words) for _ in range(8))
                    starts = k == 0 and not carry
                    made.append(line[0].upper() + line[1:] if starts or r.random() < 0.12 else line)
                    labels.append("break" if starts else "body")
                carry = 0
                if r.random() < 0.35:
                    carry = 1
                else:
                    made[-1] += "."
                elements.append((len(elements), "\n".join(made), True))
            if style:
                value = p + shift
                roman = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
                elements.append((len(elements), roman[min(p, 10)] if style == "roman" else style.format(value, n=n + shift), True))
                labels.append("page_no")
            pages.append(Page(elements))
        out.append((pages, labels))
    return out


@lru_cache(1)
def model() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Log probabilities counted on the sample: per feature (state, value), transitions, first states."""
    k = len(STATES)
    emit = [np.full((k, n), 0.5) for n in SIZES]
    move, start = np.full((k, k), 0.5), np.full(k, 0.5)
    for pages, labels in sample_pages():
        states = [STATES.index(x) for x in labels]
        for s, features in zip(states, observe(pages)):
            for table, value in zip(emit, features):
                table[s, value] += 1
        for a, b in zip(states, states[1:]):
            move[a, b] += 1
        if states:
            start[states[0]] += 1
    return [np.log(e / e.sum(1, keepdims=True)) for e in emit], np.log(move / move.sum(1, keepdims=True)), np.log(start / start.sum())


def label_lines(documents: list[list[Page]]) -> list[list[str]]:
    """The states of the lines of running text of each document."""
    emit, move, start = model()
    observed = [observe(pages) for pages in documents]
    length = np.array([len(o) for o in observed], np.int64)
    flat = np.array([f for o in observed for f in o], np.int64).reshape(-1, len(SIZES))
    score = sum(table[:, flat[:, k]].T for k, table in enumerate(emit)) if len(flat) else np.zeros((0, len(STATES)))
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(length) else length
    some = length > 0
    states = viterbi(score, begin[some], length[some], move, start, np.zeros(len(STATES)))
    out = []
    for b, n, features in zip(begin.tolist(), length.tolist(), observed):
        named = []
        for s, f in zip(states[b : b + n].tolist(), features):
            name = STATES[s]
            if name == "header" and not (f[0] == 0 and (f[1] or f[4] != 2)):
                name = "body"
            if name == "page_no" and (f[2] < 1 or f[0] not in (0, 1)):
                name = "body"
            named.append(name)
        out.append(named)
    return out


def _undone(word: str) -> list[str]:
    """What ``word`` becomes when one confusion is undone."""
    out = []
    for read, true in CONFUSIONS:
        at = word.find(read)
        while at >= 0:
            out.append(word[:at] + true + word[at + len(read) :])
            at = word.find(read, at + 1)
    return out


def _twice(low: str, count: int) -> bool:
    """Whether two confusions of a word may be undone."""
    return count < LEAST and len(low) >= 5


def _divisible(left: str, right: str) -> bool:
    return bool(left and right and left.isalpha() and right[:1].islower())


class Words:
    """The words of the collection with their counts, and what is known of written words so far."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        #: What chunks that were looked at should read, None where nothing is wrong.
        self.known_chunks: dict[str, str | None] = {}

    def __getstate__(self):
        return self.counts

    def __setstate__(self, counts):
        self.__init__(counts)

    def known(self, word: str) -> bool:
        """Whether the word is one of the collection and not rare."""
        return self.counts.get(word.lower(), 0) >= LEAST

    def true_word(self, word: str) -> str | None:
        """The word that ``word`` is a misreading of, in lower case, or None."""
        low = word.lower()
        count = self.counts.get(low, 0)
        least = max(SEEN, RATIO * count)
        once = _undone(low)
        best = max(once, key=lambda w: self.counts.get(w, 0), default=None)
        if best and self.counts.get(best, 0) >= least:
            return best
        if not _twice(low, count):
            return None
        twice = [w for o in once for w in _undone(o)]
        best = max(twice, key=lambda w: self.counts.get(w, 0), default=None)
        return best if best and self.counts.get(best, 0) >= least else None

    def repaired(self, chunk: str) -> str | None:
        """``chunk``, a run without white space, as it should read, or None if nothing is wrong."""
        if chunk in self.known_chunks:
            return self.known_chunks[chunk]
        if len(self.known_chunks) > 300_000:
            self.known_chunks.clear()
        self.known_chunks[chunk] = fixed = self._repair(chunk)
        return fixed

    def _repair(self, chunk: str) -> str | None:
        if not any(c.isalpha() for c in chunk) or "@" in chunk or "\\" in chunk or "://" in chunk or len(chunk) > 60:
            return None
        plain = unicodedata.normalize("NFC", chunk.translate(_CLEAN))
        coded = bool(re.search(r"[-_/].*\d|\d.*[-_/]", plain))
        wrong = False

        def fix(m: re.Match) -> str:
            nonlocal wrong
            word = m[0]
            if re.fullmatch(r"[\dOolI]*", word):
                digits = word.translate(str.maketrans("OolI", "0011"))
                if any(c.isdigit() for c in word) and not word.isdigit() and len(word) > 1 and not re.fullmatch(r"\d+[lI]", word):
                    wrong = True
                    return digits
                if len(word) > 1 and not word.isdigit() and coded and not self.known(word):
                    return word
            if coded and (word.isupper() or any(c.isdigit() for c in word)) or word.isdigit():
                return word
            if len(word) < 3 or (word.isupper() and any(c.isdigit() for c in word) and not self.known(word) and sum(c.isdigit() for c in word) > 1):
                return word
            if any(c.isalpha() for c in word) and (true := self.true_word(word)):
                wrong = True
                return _cased(word, true)
            return word

        fixed = _PART.sub(fix, plain)
        return fixed if wrong else None

    def divided(self, left: str, right: str) -> bool:
        """Whether ``left`` at a line end and ``right`` on the next line are one word divided there."""
        if not _divisible(left, right):
            return False
        joined, compound = (left + right).lower(), f"{left}-{right}".lower()
        whole, own = self.counts.get(joined, 0), self.counts.get(compound, 0)
        if whole or own:
            return whole >= own
        if self.true_word(left + right):
            return True
        a, b = self.counts.get(left.lower(), 0), self.counts.get(right, 0)
        return not (a >= 5 and b >= 5 and len(left) > 2 and len(right) > 2)


class Asked(Words):
    """Takes down what is asked of the words: words in lower case, and divided words as two parts around a tab."""

    def __init__(self):
        super().__init__({})
        self.new: list[str] = []
        self._seen: set[str] = set()

    def _ask(self, what: str) -> None:
        if len(self._seen) > 300_000:
            self._seen = set()
        if what not in self._seen:
            self._seen.add(what)
            self.new.append(what)

    def known(self, word: str) -> bool:
        self._ask(word.lower())
        return True

    def true_word(self, word: str) -> None:
        self._ask(word.lower())

    def divided(self, left: str, right: str) -> bool:
        # the words are asked for as they stand apart, and the joined word here
        if _divisible(left, right):
            self._ask(f"{left}\t{right}")
            self.true_word(left + right)
            self.repaired(left + right)
        return False


class Answers(Words):
    """What `answers` found out about the words that were asked for."""

    def __init__(self, found: tuple[dict[str, str], set[str], set[str]]):
        super().__init__({})
        self.found = found
        self._true, self._usual, self._joins = found

    def __getstate__(self):
        return self.found

    def known(self, word: str) -> bool:
        return word.lower() in self._usual

    def true_word(self, word: str) -> str | None:
        return self._true.get(word.lower())

    def divided(self, left: str, right: str) -> bool:
        return _divisible(left, right) and f"{left}\t{right}" in self._joins


def _cased(word: str, true: str) -> str:
    """``true`` in the case of ``word``: its own letters where they agree, capitals between capitals."""
    a = b = 0
    while a < min(len(word), len(true)) and word[a].lower() == true[a]:
        a += 1
    while b < min(len(word), len(true)) - a and word[-1 - b].lower() == true[-1 - b]:
        b += 1
    capitals = sum(c.isupper() for c in word) > 1 and not any(c.islower() for c in word)
    middle = true[a : len(true) - b]
    middle = middle.upper() if capitals else middle.capitalize() if a == 0 and word[0].isupper() else middle
    return word[:a] + middle + word[len(word) - b :]


_HYPHENS = set(HYPHENS)
_END = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*$")
_BEGIN = re.compile(r"\s*([^\W_]+)")


def _misread_line(k: int, join: tuple[int, str, str], whole: str, fixed: str) -> int:
    """The line of a misread divided word in which its first wrong character stands."""
    at = next((x for x, (p, q) in enumerate(zip(whole, fixed)) if p.lower() != q.lower()), len(whole) - 1)
    return k if at < len(join[1]) else join[0]


def _misread(kinds: list[list[str]], body: list[int], lines: list, joins: dict, into: dict, words: Words) -> None:
    """Add to ``kinds`` the body lines with a misread word."""
    known, repaired = words.known_chunks, words.repaired
    for k in body:
        chunks = lines[k][3].split()
        begin, end = int(k in into), len(chunks)
        if k in joins and begin < end:
            end -= 1
            whole = joins[k][1] + joins[k][2]
            if fixed := repaired(whole):
                kinds[_misread_line(k, joins[k], whole, fixed)].append("misread")
        elif end > begin and chunks[-1][-1] in _HYPHENS and len(chunks[-1]) > 1:
            end -= 1
        wrong = False
        for chunk in chunks[begin:end]:
            fixed = known.get(chunk, "")
            if fixed == "":
                fixed = repaired(chunk)
            wrong = wrong or fixed is not None
        if wrong:
            kinds[k].append("misread")


def examine(pages: list[Page], states: list[str], words: Words, within: bool = False, texts: bool = True):
    """(kinds, paragraphs): the noise of each line of running text, and the repaired paragraphs as (element of first line, text).

    With ``within``, a paragraph ends with its element, but for the rest of a word divided there.
    Without ``texts`` only the noise is told.
    """
    lines = [(n, e, j, line) for n, page in enumerate(pages) for e, j, line, text in page.lines if text]
    kinds: list[list[str]] = [[] for _ in lines]
    body = [k for k, s in enumerate(states) if s in ("body", "break") and lines[k][3].strip()]
    joins: dict[int, tuple[int, str, str]] = {}
    for a, b in zip(body, body[1:] + [-1]):
        m = _END.search(lines[a][3]) if lines[a][3].rstrip()[-1:] in _HYPHENS else None
        if m and b >= 0 and (w := _BEGIN.match(lines[b][3])):
            if words.divided(unicodedata.normalize("NFC", m[1].translate(_CLEAN)), unicodedata.normalize("NFC", w[1].translate(_CLEAN))):
                kinds[a].append("hyphen")
                joins[a] = (b, m[1], w[1])
    into = {b: a for a, (b, _, _) in joins.items()}
    paragraphs: list[tuple[tuple[int, int], str]] = []
    for k, state in enumerate(states):
        if state in ("header", "page_no"):
            kinds[k] = [state]
    if not texts:
        _misread(kinds, body, lines, joins, into, words)
        return kinds, []
    for k in body:
        n, e, j, line = lines[k]
        chunks = line.split()
        out = []
        for i, chunk in enumerate(chunks):
            if i == 0 and k in into:
                rest = chunk[len(joins[into[k]][2]) :]
                if rest:
                    out.append(rest)
                continue
            if i == len(chunks) - 1 and k in joins:
                head = chunk[: len(chunk.rstrip(HYPHENS)) - len(joins[k][1])]
                whole = joins[k][1] + joins[k][2]
                fixed = words.repaired(whole)
                if fixed:
                    kinds[_misread_line(k, joins[k], whole, fixed)].append("misread")
                out.append(head + (fixed or whole))
                continue
            if i == len(chunks) - 1 and chunk[-1:] in HYPHENS and len(chunk) > 1:
                out.append(chunk)
                continue
            fixed = words.repaired(chunk)
            if fixed:
                kinds[k].append("misread")
            out.append(fixed or chunk)
        if within and paragraphs and paragraphs[-1][0] != (n, e):
            if k in into and len(chunks[0]) > len(joins[into[k]][2]):
                paragraphs[-1] = (paragraphs[-1][0], paragraphs[-1][1] + out.pop(0))
            paragraphs.append(((n, e), " ".join(out)))
            continue
        text = " ".join(out)
        if k in into and paragraphs:
            glue = "" if len(_BEGIN.match(line)[0].strip()) < len(chunks[0]) else " "
            paragraphs[-1] = (paragraphs[-1][0], paragraphs[-1][1] + (glue + text if text else ""))
        elif states[k] == "body" and paragraphs:
            last = paragraphs[-1][1]
            paragraphs[-1] = (paragraphs[-1][0], last + ("" if last[-1:] in "-‐" and not last.endswith(" -") else " ") + text)
        else:
            paragraphs.append(((n, e), text))
    return kinds, paragraphs


def _documents(batch: pa.RecordBatch):
    """(id, pages, where md_results has each element or None, md lines) of the rows of a batch."""
    for id_, md, layout in zip(*(batch.column(c).to_pylist() for c in ("id", "md", "layout"))):
        pages, elements = [], []
        for n, page in enumerate(layout or [], 1):
            some = [(e["index"] if e["index"] is not None else k, e["content"], e["label"] == "text") for k, e in enumerate(page or []) if e is not None]
            pages.append(Page([x for x in some if x[1] is not None]))
            elements += [(n, *x) for x in some]
        starts = None
        if md is not None:
            for keep in (lambda c: c is not None, lambda c: bool(c and c.strip())):
                kept = [x for x in elements if keep(x[2])]
                if kept and "\n\n".join(x[2] for x in kept) == md:
                    starts, line = {}, 1
                    for n, e, content, _ in kept:
                        starts[(n - 1, e)] = line
                        line += content.count("\n") + 2
                    break
        yield id_, pages, starts, md


def _bare(md: str) -> list[Page]:
    """Pages of a text without layout, one element per block; a block that can only be a page number ends its page."""
    pages, now, line = [], [], 1
    for block in re.split(r"(\n[ \t\r]*\n+)", md):
        if block.strip():
            plain = not re.match(r"\s*(?:<table|!\[|\$\$)", block)
            now.append((line, block, plain))
            v = page_value(block) if "\n" not in block.strip() else None
            if v and (v[2] or v[0] == len(pages) + 1):
                pages.append(Page(now))
                now = []
        line += block.count("\n")
    return [*pages, Page(now)] if now or not pages else pages


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): words and hyphenated compounds with their counts over all rows."""
    whole = F.regexp_replace(column, rf"\S+[{HYPHENS}]\s*\n\S+", " ")
    found = texts.where(F.col(column).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(whole), F.lit(r"\p{L}+(?:-\p{L}+)*"), 0)).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(texts: DataFrame, column: str, least: int = LEAST) -> dict[str, int]:
    """`word_counts` of at least ``least`` as a dictionary, for small collections."""
    return {r["word"]: r["n"] for r in word_counts(texts, column).where(F.col("n") >= least).toLocalIterator()}


def _forms(batches):
    """(ask, n, form, level, at): what each word becomes when one or, where that may be, two confusions are undone."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            rows = []
            for word, n in zip(*(batch.slice(begin, 512).column(c).to_pylist() for c in ("ask", "n"))):
                once = _undone(word)
                rows += [(word, n, form, 1, at) for at, form in enumerate(once)]
                if _twice(word, n):
                    rows += [(word, n, form, 2, at) for at, form in enumerate(w for o in once for w in _undone(o))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["ask", "n", "form", "level", "at"])


def _roles(batches):
    """(pair, role, word): the words whose counts decide whether two parts are one divided word."""
    for batch in batches:
        rows = []
        for pair in batch.column("ask").to_pylist():
            left, right = pair.split("\t")
            rows += [(pair, "whole", (left + right).lower()), (pair, "own", f"{left}-{right}".lower()), (pair, "left", left.lower()), (pair, "right", right)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["pair", "role", "word"])


def true_words(asks: DataFrame, counts: DataFrame) -> DataFrame:
    """(ask, form): what those of ``asks(ask)`` that were misread should read, by all of ``counts(word, n)``."""
    own = asks.join(counts, asks.ask == counts.word, "left").select("ask", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    forms = own.mapInArrow(_forms, "ask string, n long, form string, level int, at int")
    usual = counts.where(F.col("n") >= SEEN).select(F.col("word").alias("form"), F.col("n").alias("m"))
    fit = forms.join(usual, "form").where(F.col("m") >= RATIO * F.col("n"))
    return fit.groupBy("ask").agg(F.min(F.struct("level", -F.col("m"), "at", "form"))["form"].alias("form"))


def joins(pairs: DataFrame, fixes: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair): those of ``pairs(ask)`` that are one divided word."""
    roles = pairs.mapInArrow(_roles, "pair string, role string, word string").join(counts, "word", "left")
    roles = roles.join(fixes.select(F.col("ask").alias("word"), F.lit(True).alias("misread")), "word", "left")
    n = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(role)
    by = roles.groupBy("pair").agg(n("whole"), n("own"), n("left"), n("right"), F.coalesce(F.bool_or((F.col("role") == "whole") & F.col("misread")), F.lit(False)).alias("misread"))
    size = lambda k: F.char_length(F.split_part("pair", F.lit("\t"), F.lit(k)))
    apart = (F.col("left") >= 5) & (F.col("right") >= 5) & (size(1) > 2) & (size(2) > 2)
    return by.where(F.when((F.col("whole") > 0) | (F.col("own") > 0), F.col("whole") >= F.col("own")).otherwise(F.col("misread") | ~apart)).select("pair")


def answers(asks: DataFrame, counts: DataFrame) -> Answers:
    """What ``asks(ask)`` ask for, decided on all of ``counts(word, n)``: only repairs and joins come to the driver."""
    counts, asks = materialize(counts, "counts"), materialize(asks.distinct(), "asks")
    pair = F.contains("ask", F.lit("\t"))
    words = asks.where(~pair)
    fixes = materialize(true_words(words, counts), "fixes")
    # only of words of these letters it is asked whether they are known: others with digits never are
    usual = words.where(F.col("ask").rlike("^[oli]+$")).join(counts.where(F.col("n") >= LEAST), words.ask == counts.word)
    whole = {r["ask"]: r["form"] for r in fixes.toLocalIterator()}
    return Answers((whole, {r["ask"] for r in usual.select("ask").toLocalIterator()}, {r["pair"] for r in joins(asks.where(pair), fixes, counts).toLocalIterator()}))


LAYOUT = "array<array<struct<index:int,label:string,content:string>>>"


def _labelled(df: DataFrame) -> DataFrame:
    """``df`` with the states of its lines, as digits, and what it asks of the words; a task asks the same thing once."""

    def run(batches):
        asked = Asked()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                documents = list(_documents(part))
                bare = [_bare(md) if md and starts is None else [] for _, _, starts, md in documents]
                both, asks = (label_lines([pages for _, pages, _, _ in documents]), label_lines(bare)), []
                for (_, pages, _, _), b, states, bare_states in zip(documents, bare, *both):
                    examine(pages, states, asked, texts=False)
                    examine(b, bare_states, asked, texts=False)
                    asks.append(asked.new)
                    asked.new = []
                digits = [pa.array(["".join(str(STATES.index(s)) for s in states) for states in some], pa.string()) for some in both]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "md", "layout")), *digits, pa.array(asks, pa.list_(pa.string()))], names=["id", "md", "layout", "states", "bare_states", "asks"])

    return df.mapInArrow(run, f"id string, md string, layout {LAYOUT}, states string, bare_states string, asks array<string>")


def _with_words(df: DataFrame, words: dict[str, int] | DataFrame) -> tuple[DataFrame, Words]:
    """The rows to go through, and what is known of words: by a dictionary, or by a table (word, n) of any size."""
    if isinstance(words, dict):
        return _prepared(df), Words(words)
    rows = materialize(_labelled(_prepared(df)), "labelled")
    return rows.drop("asks"), answers(rows.select(F.explode("asks").alias("ask")), words)


def _run(df: DataFrame, words: Words, emit, schema: str) -> DataFrame:
    labelled = "states" in df.columns

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                documents = list(_documents(part))
                bare = [_bare(md) if md and starts is None else [] for _, _, starts, md in documents]
                if labelled:
                    states, bare_states = ([[STATES[int(c)] for c in x] for x in part.column(name).to_pylist()] for name in ("states", "bare_states"))
                else:
                    states, bare_states = label_lines([pages for _, pages, _, _ in documents]), label_lines(bare)
                rows = [row for d, s, b, bs in zip(documents, states, bare, bare_states) for row in emit(words, *d, s, b, bs)]
                columns = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32() if "int" in schema else pa.string()))], names=[x.split()[0] for x in schema.split(", ")])

    return df.mapInArrow(run, schema)


def _found(words, id_, pages, starts, md, states, bare, bare_states):
    lines = [(n, e, j) for n, page in enumerate(pages) for e, j, _, text in page.lines if text]
    kinds, _ = examine(pages, states, words, texts=False)
    for (n, e, j), found in zip(lines, kinds):
        for kind in set(found):
            yield f"l:{id_}:p{n + 1}:e{e}", kind, j + 1
            if starts is not None and (n, e) in starts:
                yield f"m:{id_}", kind, starts[(n, e)] + j
    if bare:
        lines = [(e, j) for page in bare for e, j, _, text in page.lines if text]
        for (line, j), found in zip(lines, examine(bare, bare_states, words, texts=False)[0]):
            for kind in set(found):
                yield f"m:{id_}", kind, line + j


def _whole(pages: list[Page], paragraphs: list) -> list[tuple[tuple[int, int], str]]:
    """(page and element, text) of repaired paragraphs and of what isn't running text, in order."""
    others = [((n, e), content) for n, page in enumerate(pages) for e, content in {e: "\n".join(x for f, _, x, t in page.lines if f == e and not t) for e, _, _, t in page.lines if not t}.items()]
    merged = sorted([(at, 0, text) for at, text in paragraphs] + [(at, 1, text) for at, text in others], key=lambda x: x[0])
    return [(at, text) for at, _, text in merged if text.strip()]


def _repaired(words, id_, pages, starts, md, states, bare, bare_states):
    own: dict[tuple[int, int], list[str]] = {}
    for at, text in _whole(pages, examine(pages, states, words, within=True)[1]):
        own.setdefault(at, []).append(text)
    for n, page in enumerate(pages):
        for e, content in page.contents.items():
            yield f"l:{id_}:p{n + 1}:e{e}", content, "\n\n".join(own.get((n, e), []))
    if md is not None:
        use, labels = (pages, states) if starts is not None else (bare, bare_states)
        yield f"m:{id_}", md, "\n\n".join(text for _, text in _whole(use, examine(use, labels, words)[1]))


def _prepared(df: DataFrame) -> DataFrame:
    return df.select(F.col("id"), F.col("md_results").alias("md"), F.transform("layout_details", lambda p: F.transform(p, lambda e: F.struct(e["index"].alias("index"), e["label"].alias("label"), e["content"].alias("content")))).alias("layout"))


def noisy_lines(df: DataFrame, words: dict[str, int] | DataFrame) -> DataFrame:
    """(item_key, noise_kind, line_no) of ``df(id, md_results, layout_details)``, by words and counts."""
    return _run(*_with_words(df, words), _found, "item_key string, noise_kind string, line_no int")


def repaired_texts(df: DataFrame, words: dict[str, int] | DataFrame) -> DataFrame:
    """(item_key, original, repaired) of each md_results and content of a layout element that isn't null."""
    return _run(*_with_words(df, words), _repaired, "item_key string, original string, repaired string")
