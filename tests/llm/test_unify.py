import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import unify


def one(*texts):
    return unify.unify_array(pa.array(texts, pa.string())).to_pylist()


def test_same_looks_are_equal():
    same = ["caf\u00e9 no. 7", "cafe\u0301 no. 7", "\uff43\uff41\uff46\u00e9 no. 7", "ca\u200bf\u00e9 no.\u00a07", "\u0441af\u00e9 n\u03bf. 7 "]
    assert len(set(same)) == 5 and set(one(*same)) == {"caf\u00e9 no. 7"}
    assert one("ﬁne ⅡI", "of‐f") == ["fine III", "of-f"]
    assert one(None, "", " \t\n", "a\r\nb\rc") == [None, "", "", "a\nb\nc"]


def test_different_looks_stay_apart():
    texts = ["cafe", "café", "Cafe", "m2", "m²", "a-b", "a–b", "a b", "ab", "5", "S", "👩‍🔧", "👩🔧", "…", "..."]
    assert len(set(one(*texts))) == len(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aeqsoAE ̧̣́̀̂ộé", max_size=12), min_size=1, max_size=5))
def test_marks_compose_as_the_standard_has_it(texts):
    assert one(*texts) == [unicodedata.normalize("NFC", t).strip(" ") for t in texts]
    assert one(*one(*texts)) == one(*texts)


def test_pairs(spark):
    rows = [("d", "1", "caf\u00e9"), ("d", "2", "cafe\u0301"), ("d", "2", "cafe\u0301"), ("d", "3", "caf\u00e9"), ("e", "4", "cafe\u0301"), ("d", "5", None), ("d", "6", " "), ("d", "7", "")]
    items = spark.createDataFrame(rows, "scope string, item_key string, content string")
    got = sorted((r.left_key, r.right_key) for r in unify.look_alike_pairs(unify.look_alike_groups(items)).collect())
    assert got == [("1", "2"), ("2", "3")]
    df = spark.createDataFrame([("x", "ａ", 1)], "unified string, t string, c0 int")
    assert unify.with_unified(df, "t").first().asDict() == {"t": "ａ", "c0": 1, "unified": "a"}
    assert unify.look_alike_pairs(unify.look_alike_groups(items.where("false"))).count() == 0
