import numpy as np

from quillspark.operators import search as R
from quillspark.operators.vectors import VectorIndex


def test_index_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 16))
    rows = [(str(i), (centres[i % 20] + 0.2 * r.normal(size=16)).tolist(), i % 3) for i in range(600)] + [("null", None, 0), ("zero", [0.0] * 16, 0), ("short", [1.0], 0)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, page int")
    index = VectorIndex(spark, str(tmp_path), "one")
    assert index.create(df, 16) and not index.create(df, 16)
    index.add(df.where("coalesce(try_cast(id as int), 0) < 300"))
    index.add(df.where("try_cast(id as int) >= 300"))
    asked = df.where("try_cast(id as int) % 50 = 0").selectExpr("id as query_id", "vector")
    exact = {(x.query_id, x.id) for x in R.nearest(df.where("length(id) < 4").select("id", "vector"), asked, 5).collect()}
    got = {(x.query_id, x.id) for x in index.search(asked, 5, probes=6).collect()}
    assert len(got & exact) >= 0.9 * len(exact) and index.rows().count() == 600
    every = {(x.query_id, x.id, x.score) for x in index.search(asked, 5, probes=16).collect()}
    assert every == {(x.query_id, x.id, x.score) for x in R.nearest(df.where("try_cast(id as int) is not null").select("id", "vector"), asked, 5).collect()}
    pages = index.search(asked, 5, 16, "page = :p", p=1).join(index.rows(), "id").select("page").distinct().collect()
    assert [x.page for x in pages] == [1]
    assert index.search(asked.where("false"), 5).count() == 0
