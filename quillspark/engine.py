"""One object for the whole engine over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, text
from .operators import compare, detect, evaluate, ingest, report, search
from .session import ship
from .sources.tables import table


class Engine:
    """Ingest, search, detection, comparison and evaluation over the tables of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def info(self) -> dict:
        return {"engine": "quillspark", "spark": self.spark.version, "strategies": list(search.STRATEGIES)}

    def units(self) -> DataFrame:
        """Evidence units as they were last delivered."""
        return ingest.upserted(self.table("evidence_units"))

    def corpus(self) -> DataFrame:
        return self.units().select(F.col("evidence_id").alias("id"), F.col("content").alias("text"), "document_id")

    def status(self) -> DataFrame:
        return ingest.latest_status(self.table("status_log"))

    def search(self, queries: DataFrame | str, strategy: str = "hybrid", k: int = 10, documents: list[str] | None = None) -> DataFrame:
        """Hits of queries(query_id, query), or of one text; a regular expression is searched as one by the lexical and rg strategies."""
        rows = search.of_documents(self.corpus(), documents)
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([("q", queries)], "query_id string, query string")
        return search.run(self.spark, rows.select("id", "text"), queries, strategy, k)

    def grounded(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The best evidence of each query's own document, for queries(query_id, query, document_id)."""
        return search.grounded(self.corpus(), queries, k)

    def detect(self, claims: DataFrame) -> DataFrame:
        return detect.detect(claims)

    def compare(self, pairs: DataFrame, mode: str = "standard", strategy: str = "lexical") -> DataFrame:
        return compare.compare(self.units(), pairs, mode, strategy)

    def summarize(self, changes: DataFrame) -> DataFrame:
        return report.summaries(changes)

    def evaluate(self, hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
        return evaluate.means(evaluate.retrieval(hits, qrels, k))

    def facts(self) -> DataFrame:
        return extract.with_facts(self.units().select("evidence_id", "content"), "content")

    def register(self) -> None:
        """Make the similarity of two texts callable from SQL."""
        from .operators.diff import ratio

        self.spark.udf.register("quill_similarity", lambda a, b: None if a is None or b is None else float(ratio(text_flat(a), text_flat(b))), "double")


def text_flat(s: str) -> str:
    return " ".join(s.lower().split())


__all__ = ["Engine", "text"]
