import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import reading as R
from quillspark.llm.codepoints import to_codes

# ---- the same features text by text, to test the arrays against
_BRACKET = re.compile(r"\([^()\n]*\)|\[[^\[\]\n]*\]")
_BULLET = re.compile(r"^\s*(?:[-•*–]|\d{1,3}[.)]|[a-z]\))\s+")
_SKIP = re.compile(r"^\s*(?:#|\||<|!\[)|\|.*\||^\s*(?:total|ref|n°)\b\s*:", re.I)
_END = re.compile(r"(?<=[.!?…])[\"'»)\]]*\s+(?=[^\W\d_a-zà-ÿ]|[\"«(])|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def words_of(text: str) -> list[str]:
    return [p for w in _WORD.findall(text.lower()) for p in re.split(r"['’]", w) if p]


def sentences(text: str) -> list[str]:
    """The sentences of running text, without headings, table rows, bullets and brackets."""
    out = []
    for line in re.split(r"\r\n?|\n", text):
        if not line.strip() or _SKIP.search(line):
            continue
        line = _BRACKET.sub(" ", _BULLET.sub("", line))
        for s in _END.split(line):
            if s and len(s.split()) >= 2 and not (len(s.split()) < 5 and s.strip()[-1:] not in ".!?;…"):
                out.append(s)
    return out


def language(words: list[str]) -> str:
    """"en" or "fr", whichever's function words are more; "en" in a tie."""
    en = sum(w in R.FUNCTION["en"] for w in words)
    return "fr" if sum(w in R.FUNCTION["fr"] for w in words) > en else "en"


def window_starts(n: int, window: int) -> list[int]:
    """Where windows over ``n`` words begin: every half window, and where the last one ends with the words."""
    last = max(0, n - window)
    return sorted({*range(0, last + 1, window // 2), last})


def features(text: str, rarity, rarest) -> tuple[str, list[float]]:
    """(language, features) of a text."""
    parts = sentences(text) or [text]
    lists = [w for w in (words_of(s) for s in parts) if w] or [["-"]]
    words = [w for ws in lists for w in ws]
    lang = language(words)
    content = [w for w in words if w not in R.FUNCTION[lang] and len(w) > 1] or words
    lengths = np.array([len(ws) for ws in lists], float)
    letters = np.array([len(w) for w in content], float)
    window = 60
    spans = [words[i : i + window] for i in window_starts(len(words), window)]
    diversity = float(np.mean([len(set(s)) / len(s) for s in spans]))
    rare = np.array([rarity.get(w, rarest) for w in content])
    links = sum(w in R.CONNECTIVES[lang] for w in words) / len(words)
    depth = sum(s.count(",") + s.count(";") + s.count(":") for s in parts) + sum(w in ("which", "that", "whereby", "who", "qui", "que", "dont", "où", "lequel") for w in words)
    return lang, [math.log(lengths.mean()), math.log(np.median(lengths)), math.log(letters.mean()), float((letters >= 7).mean()), float((letters >= 10).mean()), diversity, float(rare.mean()), float((rare > -math.log(R.RARE)).mean()), links * 10, math.log1p(depth / len(parts))]


LEVELS = [("The van is late. Call us now. Put it away. ", 1), ("The driver must return the broken parts on the agreed date, so the clerk can report it. ", 2), ("The contractual penalty shall not be modified without the payment guarantee although the final quantities may vary according to the season. ", 3), ("Notwithstanding any stipulation to the contrary contained in the aforementioned instruments, the irrevocable subordination arrangement, insofar as the beneficiary demonstrates the materiality of the alleged misrepresentation, shall neither diminish nor otherwise compromise enforceability. ", 4)]


NONE = R.Rarity(np.zeros(0, np.uint64), np.zeros(0))
SHARES = {"the": 0.05, "van": 1e-5, "is": 0.02, "late": 4e-5, "call": 1e-3, "penalty": 2e-6}
KNOWN = R.Rarity(R.hashes_of(SHARES), np.array(list(SHARES.values())))


def graded(n=12):
    r = random.Random(1)
    return [(s * r.randint(3, 8) + r.choice(["", "\n\n# Heading\n", "\na | 1 | 2\n"]), k) for s, k in LEVELS for _ in range(n)]


def test_levels_are_told_apart():
    g = R.Grader(NONE).fit(graded())
    assert all(g.grade(t)[0] == k for t, k in graded(5)) and g.grade(LEVELS[0][0].upper() * 5)[0] == 1
    scores = [g.grade(s * 5)[1] for s, _ in LEVELS]
    assert scores == sorted(scores)


def test_ordinal_fit_recovers_order():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = np.digitize(x[:, 0] * 3 + r.logistic(size=300), [-2, 0, 2])
    w, cuts = R.fit_ordinal(x, y, 4)
    assert abs(w[0] - 3) < 1 and abs(w[1]) < 0.5 and (np.diff(cuts) > 0).all()


def test_sentences_leave_furniture_out():
    assert sentences("# Title\n- Pay the rest (approx. 2.5 t) by ten. Call us now!\na | b | 3\n\n4. Scope") == ["Pay the rest   by ten.", "Call us now!"]


def test_table(spark):
    g = R.Grader(NONE).fit(graded())
    df = spark.createDataFrame([(1, LEVELS[0][0] * 8, "x"), (2, "too short", "y"), (3, None, None), (4, "1 2 3 " * 30, "z")], "c0 int, t string, level string")
    rows = {r.c0: r.level for r in R.with_level(df, "t", g).collect()}
    assert rows[1] == 1 and rows[2] is None and rows[3] is None and rows[4] in (1, 2, 3, 4)
    assert R.with_level(df.where("false"), "t", g).count() == 0
    rarity = R.rarities(df.select("t"), "t")
    late, unheard = rarity.of(R.hashes_of(["late", "unheard"]))
    assert 0 < late < 5 and unheard == pytest.approx(-math.log(R.SHARE))
    assert R.rarities(df.where("false"), "t").of(R.hashes_of(["late"])).tolist() == [pytest.approx(-math.log(R.SHARE))]


def test_windows_reach_the_last_word():
    assert [window_starts(n, 60) for n in (0, 59, 60, 61, 90, 100)] == [[0], [0], [0], [0, 1], [0, 30], [0, 30, 40]]
    same = "word " * 90
    assert computed([same + "word " * 10])[1][0][5] < computed([same + "ab cd ef gh ij kl mn op qr st"])[1][0][5]


def computed(texts, rarity=NONE):
    return R.features(*to_codes(pa.array(texts, pa.string())), rarity)


ODD = ["", "x", "-", "12 34 5", 'a) b. c) D e. "F g." H i', "# h\n| a | b |", 'He said "no." Then (x (y) z) left. Il dit «Non.» Puis l’été d\'hiver-là.\r\n- ok\r\n12. Go there now. ', "Total : 5 EUR\nRef: a\nReferee: no way.", '(unclosed. Open "Quote." (Par.) Next one…  End', " \n\n", "A. B. C.\nD", "1. The van is late. Call.\n\n• The penalty\n![x] y\n<b> z"]


def same(texts):
    rarity = {w: -math.log(max(s, R.SHARE)) for w, s in SHARES.items()}
    lang, x = computed(texts, KNOWN)
    for k, t in enumerate(texts):
        name, f = features(t, rarity, -math.log(R.SHARE))
        if not any(c.isalpha() for c in t):
            f[6:8] = x[k][6:8]  # no word at all
        assert R.LANGS[lang[k]] == name and np.allclose(f, x[k], atol=1e-5), (t, f, x[k])


def test_arrays_give_the_features_of_each_text():
    same(ODD + [t for t, _ in graded(3)])
    same(ODD[::-1])
    assert computed([])[1].shape == (0, len(R.NAMES))


PARTS = ["The van is late", "call us", "Il dit", "l’été", "que", ". ", "! ", "… ", '." ', "» ", " (", ") ", "[", "] ", "\n", "\r\n", "- ", "3. ", "| ", "well-known", ", ", "Notwithstanding", " ", "#", "a) "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=4))
def test_arrays_agree_on_any_text(texts):
    same(texts)
