import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import encode, pack

ODD = ["", None, "a" * 900, " " * 300 + "x", "ab " * 99 + "\n\n\n" + "don't we'll " * 30, "é" * 70 + " 12" * 90, "'ll" * 200, "\t \n" * 150, "<|endoftext|> x", "日本語 テスト" * 20, "a\x00b"]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (40, 8)])
def test_ids_are_those_of_the_whole_text(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(ODD)], "i int, text string, uid int, c0 string")
    out = {r.i: r for r in encode.with_token_ids(df, chunk=chunk, overlap=overlap).collect()}
    e = encode.encoder()
    assert len(out) == len(ODD)
    for i, t in enumerate(ODD):
        assert list(out[i].ids) == (e.encode_ordinary(t) if t else []) and out[i].uid == 5
        assert encode.decode(list(out[i].ids)) == (t or "")


def test_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ODD:
        if text:
            assert t.encode(text, add_special_tokens=False).ids == encode.encoder().encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_windows_hold_all_items(sizes):
    s = np.array(sizes, np.int64)
    windows, _ = pack.pack(s, 50)
    assert sorted(i for w in windows for i in w) == list(range(len(s)))
    assert all(s[w].sum() <= 50 for w in windows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=70), st.integers(1, 20))
def test_differencing_keeps_items_and_loads(sizes, k):
    s = np.array(sizes, np.int64)
    loads, members = pack.difference(s, k)
    assert sorted(i for w in members for i in w) == list(range(len(s))) and len(members) <= k
    assert [int(s[w].sum()) for w in members] == loads.tolist() == sorted(loads.tolist(), reverse=True)


def _best_fit_falling(sizes, capacity):
    rooms = []
    for x in sorted((int(x) for x in sizes if x), reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms[rooms.index(min(fits))] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_never_more_windows_than_best_fit(capacity):
    r = np.random.default_rng(capacity)
    for sizes in (r.lognormal(5.6, 1.1, 700), r.uniform(0, capacity, 500), np.full(300, capacity // 3 + 1), np.full(200, capacity)):
        s = np.minimum(sizes.astype(np.int64), capacity)
        windows, share = pack.pack(s, capacity)
        assert len(windows) <= _best_fit_falling(s, capacity) and 0 <= share <= 1
        assert max(s[w].sum() for w in windows) <= capacity


def test_windows_are_nearly_equal_where_many_items_fit():
    r = np.random.default_rng(0)
    s = np.minimum(r.lognormal(5.4, 0.9, 2000).astype(np.int64) + 1, 2047)
    windows, share = pack.pack(s, 8192)
    loads = [int(s[w].sum()) for w in windows]
    assert share > 0.5 and len(windows) == -(-int(s.sum()) // 8192) and max(loads) - min(loads) < 8192
    assert pack.difference(np.array([8, 7, 6, 5, 4]), 2)[0].tolist() == [16, 14]
    assert pack.pack(np.array([], np.int64), 5) == ([], 1.0) and pack.pack(np.array([0, 0]), 5)[0] == [[0, 1]]


def test_containers(spark):
    rows = [(k, n, "small", 10) for k, n in [(1, 25), (2, 10), (3, 0), (4, None), (5, 7), (6, 3), (6, 3)]]
    df = spark.createDataFrame(rows, "key long, n int, kind string, capacity int")
    out = pack.with_containers(df, "key", "n", "capacity", "kind").collect()
    load = {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.size
    assert max(load.values()) <= 10 and sorted((r.key, r.part, r.begin, r.size) for r in out if r.key == 1) == [(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 5)]
    assert sorted({r.key for r in out}) == [1, 2, 3, 4, 5, 6] and len([r for r in out if r.key == 6]) == 1
    assert pack.with_containers(df.where("false"), "key", "n", "capacity", "kind").count() == 0


def test_ids_give_the_text_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, text string")
    coded = encode.with_token_ids(df).withColumnRenamed("text", "made").unionByName(spark.createDataFrame([(99, None, None)], "i int, made string, ids array<int>"))
    out = {r.i: r for r in encode.with_text(coded, "ids", "text").collect()}
    assert all(out[i].text == (t or "") and out[i].made == t for i, t in enumerate(ODD)) and out[99].text is None
