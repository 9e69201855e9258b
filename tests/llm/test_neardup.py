import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import neardup as N
from quillspark.llm.codepoints import to_codes

WORDS = [f"w{k}x" for k in range(300)]


def made(seed=2):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(60)] for _ in range(25)]
    out = []
    for k, b in enumerate(base):
        for v in range(4):
            w = list(b)
            for _ in range(v * 2):
                w[r.randrange(len(w))] = r.choice(WORDS)
            if v == 3:
                w = w[30:] + w[:30]
            out.append((f"t{k}-{v}", " ".join(w) + "."))
    out += [("copy-a", out[0][1].upper()), ("copy-b", out[0][1]), ("copy-b", out[0][1]), ("short", "one two three"), ("null", None), ("empty", ""), (None, out[0][1]), ("long", " ".join(WORDS * 40))]
    return out


def grams(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 24 else set()


@pytest.mark.parametrize("crowd", [200, 2])
def test_links_against_brute_force(spark, crowd):
    rows = made()
    df = spark.createDataFrame(rows, "id string, t string")
    members, links = N.near_copies(df, "id", "t", 0.6, 24, crowd=crowd)
    form = {r.key: bytes(r.form) for r in members.collect()}
    got = {frozenset((bytes(x.form_a), bytes(x.form_b))) for x in links.collect()}
    sets = {i: grams(t) for i, t in rows if i and t and grams(t)}
    assert set(form) == set(sets)
    want = set()
    for a, b in itertools.combinations(sets, 2):
        s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert (form[a] == form[b]) == (sets[a] == sets[b])
        if s >= 0.6 and form[a] != form[b]:
            want.add(frozenset((form[a], form[b])))
    assert got == want and len(want) > 30


def test_words_and_occurrences():
    words, at = N.word_hashes(*to_codes(pa.array(["Éa b_c, éA", "", None, "x"])))
    assert np.diff(at).tolist() == [4, 0, 0, 1] and words[0] == words[3] and len(set(words.tolist())) == 4
    assert N.occurrences(np.array([5, 5, 5, 7, 5], np.uint64), np.array([0, 2, 5])).tolist() == [0, 1, 0, 0, 1]


def test_banded_similarity_is_exact():
    r = np.random.default_rng(1)
    lists = [np.unique(r.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)]
    for x in lists:
        r.shuffle(x)
    a, b = lists[::2], lists[1::2]
    at = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    got = N.similarities(np.concatenate(a), at(a), np.concatenate(b), at(b), 0.3, band=3)
    for g, x, y in zip(got, a, b):
        true = len(set(x) & set(y)) / len(set(x) | set(y))
        assert abs(g - true) < 1e-12 or (true < 0.3 and g < 0.3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string")
    members, links = N.near_copies(df, "id", "t")
    assert members.count() == 0 and links.count() == 0


def test_large_classes_come_out_as_all_pairs(spark):
    """A class of 150 ids in three writings, one of 64, and one of 65."""
    from quillspark.llm import queries

    base = " ".join(WORDS[:40])
    texts = [base, base.upper() + ".", base.replace(" ", "\n")]
    rows = [(f"a{k:03}", texts[k % 3]) for k in range(150)]
    rows += [(f"b{k:03}", " ".join(WORDS[100:140])) for k in range(64)] + [(f"c{k:03}", " ".join(WORDS[200:240])) for k in range(65)]
    df = spark.createDataFrame(rows + rows[:9], "id string, t string")
    got = [tuple(r) for r in queries.p6_pairs(*N.near_copies(df, "id", "t", 0.6, 24)).collect()]
    want = {(x, y) for (x, _), (y, _) in itertools.combinations(rows, 2) if x[0] == y[0]}
    assert set(got) == want and len(got) == len(want) == 15271


def test_crowded_buckets_stay_apart(spark):
    """Texts that share a passage, more in a batch than a bucket may hold, give the links of brute force."""
    r = random.Random(5)
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    rows = [(f"p{k:03}", f"{passage} " + " ".join(r.choice(WORDS) for _ in range(12 + 40 * (k % 2)))) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, t string").coalesce(1)
    members, links = N.near_copies(df, "id", "t", 0.6, 24, crowd=5)
    form = {r.key: bytes(r.form) for r in members.collect()}
    sets = {i: grams(t) for i, t in rows}
    want = {frozenset((form[a], form[b])) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {frozenset((bytes(x.form_a), bytes(x.form_b))) for x in links.collect()} == want and len(want) > 100
