import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import split


def codes(t):
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r,;é́🚚 ", max_size=400), st.integers(2, 60), st.integers(0, 30))
def test_pieces_fit_and_lose_nothing(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            split.cuts(codes(text), limit, overlap)
        return
    bounds = [0, *split.cuts(codes(text), limit, overlap), len(text)]
    assert bounds == sorted(bounds) and "".join(text[a:b] for a, b in zip(bounds, bounds[1:])) == text
    if len(text) > limit:
        assert all(b - a <= limit - overlap for a, b in zip(bounds, bounds[1:]))


def test_cuts_fall_at_boundaries_and_keep_their_places():
    text = " ".join(f"Sentence number {k} says that the {k * 7 % 13} pumps were late again." for k in range(200))
    cut = split.cuts(codes(text), 600, 60)
    assert all(text[c - 2 : c] == ". " for c in cut)
    edited = text[:100] + "an inserted remark. " + text[100:]
    moved = {c - 20 for c in split.cuts(codes(edited), 600, 60)}
    assert len(moved & set(cut)) >= len(cut) - 3


def test_words_without_end_and_marks():
    assert max(np.diff([0, *split.cuts(codes("x" * 5000), 100, 10), 5000])) <= 90
    text = "é" * 300
    assert all(text[c] != "́" for c in split.cuts(codes(text), 50, 5))


def test_table(spark):
    rows = [("a", "one. two. " * 30, 50, 5, 9), ("a", "one. two. " * 30, 50, 5, 9), ("b", None, 50, 5, 1), ("c", "", 50, 5, 2), ("d", "short", None, None, 3)]
    df = spark.createDataFrame(rows, "k string, t string, lim int, lap int, piece int")
    out = split.with_pieces(df, "t", "lim", "lap").collect()
    by = {k: [r for r in out if r.k == k] for k in "abcd"}
    assert len(by["a"]) % 2 == 0 and max(len(r.piece) for r in by["a"]) <= 50 and by["b"] == [] and by["c"][0].piece == "" and by["d"][0].piece == "short"
    assert all(r.new_pos - r.start_pos == 5 for r in by["a"] if r.piece_no)
    assert split.with_pieces(df.where("false"), "t", "lim", "lap").count() == 0
