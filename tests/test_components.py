import random

from quillspark.operators.components import components


def test_against_union_find(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(80):03d}", f"n{r.randrange(80):03d}") for _ in range(50)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("x", "x"), (None, "y")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == {n: root(n) for n in parent}


def test_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
