"""An index of vectors by inverted lists around centroids.

Centroids are fitted on a bounded sample; every vector is indexed, in the list of its nearest
centroid. A query looks into the lists of its nearest centroids only, so what is compared
grows with the share of lists probed. `search.nearest` is the exact way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import exists
from .search import best, filtered

#: Vectors that centroids are fitted on at most, lists, and lists that a query probes.
SAMPLE, LISTS, PROBES = 20_000, 32, 24


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, steps: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of vectors(id, vector), by k-means over directions of at most ``sample`` of them, those whose ids hash lowest."""
    some = vectors.where("vector is not null").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).select("vector").toArrow().column("vector").to_pylist()
    if not some:
        return np.zeros((0, 0))
    width = len(some[0])
    x = np.array([v for v in some if len(v) == width], np.float64)
    x = _unit(x[np.linalg.norm(x, axis=1) > 0])
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(steps):
        of = (x @ c.T).argmax(1)
        for k in range(len(c)):
            own = x[of == k]
            c[k] = own.mean(0) if len(own) else x[r.integers(len(x))]
        c = _unit(c)
    return c


def placed(rows: DataFrame, centroids: np.ndarray, lists: int = 1, column: str = "vector") -> DataFrame:
    """``rows`` with ``list``, once for each of the ``lists`` nearest centroids; null and zero vectors, and those of another length, are left out."""
    base = rows.drop("list")
    which = base.columns.index(column)
    schema = T.StructType([*base.schema.fields, T.StructField("list", T.IntegerType())])
    names, width = schema.names, centroids.shape[1] if centroids.size else -1

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(which)), width))
            if not batch.num_rows:
                continue
            x = batch.column(which).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            some = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
            near = np.argsort(-(_unit(x[some]) @ centroids.T), axis=1, kind="stable")[:, :lists]
            batch = batch.take(pa.array(np.repeat(some, near.shape[1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.reshape(-1).astype(np.int32))], names=names)

    return base.mapInArrow(run, schema)


def nearest_in_lists(lists: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = 10, probes: int = PROBES) -> DataFrame:
    """(query_id, id, score, rank): of the vectors in the probed lists those of highest cosine; ``lists(id, vector, list)``, ``queries(query_id, vector)``."""
    asked = placed(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").alias("asked")), centroids, probes, "asked")
    both = lists.select(F.col("id").cast("string").alias("id"), "vector", "list").join(asked, "list").select("query_id", "id", "vector", "asked")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_unit(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)) for c in ("vector", "asked"))
                score = np.round(np.einsum("ij,ij->i", a, b), 6)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)], names=["query_id", "id", "score"])

    return best(both.mapInArrow(run, "query_id string, id string, score double"), k)


class VectorIndex:
    """A named index in a folder: its centroids, and the vectors in their lists with any other columns."""

    def __init__(self, spark: SparkSession, path: str, name: str = "default"):
        self.spark, self.at = spark, f"{path}/{name}"

    def create(self, vectors: DataFrame, lists: int = LISTS) -> bool:
        """Fit and keep the centroids; nothing, and False, where the index is there already."""
        if exists(self.spark, f"{self.at}/centroids"):
            return False
        c = fit(vectors, lists)
        self.spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(c)], "list int, vector array<double>").write.parquet(f"{self.at}/centroids")
        return True

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.at}/centroids").orderBy("list").collect()  # as many as there are lists
        return np.array([r.vector for r in rows])

    def add(self, rows: DataFrame) -> None:
        """Append rows(id, vector, ...), sorted by list so that a search skips to what it probes."""
        placed(rows, self.centroids()).repartition("list").sortWithinPartitions("list").write.mode("append").parquet(f"{self.at}/lists")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/lists")

    def search(self, queries: DataFrame, k: int = 10, probes: int = PROBES, condition: str | None = None, **values) -> DataFrame:
        """The k nearest of the rows that meet a condition with named values."""
        return nearest_in_lists(filtered(self.rows(), condition, **values), queries, self.centroids(), k, probes)
