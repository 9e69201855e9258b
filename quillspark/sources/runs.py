"""Stores of experiment and comparison runs, a cache of bytes, and the settings of the engine."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..session import exists, remove

RUN = "run_id string, created_at timestamp, kind string, config string, result string"
STATUS = "run_id string, left_document_id string, right_document_id string, status string, error string, result string, at timestamp"


def save_run(runs: DataFrame, path: str, kind: str) -> None:
    """Append runs(run_id?, created_at?, config, result) to a store; what lacks is made: an id, the time now. Structs are kept as JSON."""
    base = runs if "run_id" in runs.columns else runs.withColumn("run_id", F.uuid())
    base = base if "created_at" in base.columns else base.withColumn("created_at", F.current_timestamp())
    text = {c: F.col(c).cast("string") if t == "string" else F.to_json(c) for c, t in base.dtypes if c in ("config", "result")}
    made = {c: text.get(c, F.lit(None).cast("string")) for c in ("config", "result")}
    base.select("run_id", F.col("created_at").cast("timestamp").alias("created_at"), F.lit(kind).alias("kind"), *[v.alias(c) for c, v in made.items()]).write.mode("append").parquet(path)


def list_runs(spark: SparkSession, path: str, limit: int = 25, kind: str | None = None) -> DataFrame:
    """The latest runs of a store; of equal times the larger id first."""
    rows = spark.read.schema(RUN).parquet(path)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def get_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(path).where(F.col("run_id") == run_id)


def log_status(spark: SparkSession, path: str, status: str, run_id: str | None = None, left: str | None = None, right: str | None = None, error: str | None = None, result: str | None = None) -> str:
    """Append a status of a comparison run: queued (which makes it), running, completed or failed. Returns its id."""
    run_id = run_id or uuid.uuid4().hex
    row = spark.createDataFrame([(run_id, left, right, status, error, result)], STATUS.rsplit(", ", 1)[0]).withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(path)
    return run_id


def comparison_runs(spark: SparkSession, path: str) -> DataFrame:
    """Each comparison run with its last status; its documents are those it was made with."""
    return latest_comparisons(spark.read.schema(STATUS).parquet(path))


def latest_comparisons(log: DataFrame) -> DataFrame:
    order = F.struct("at", "status")
    return log.groupBy("run_id").agg(F.max("left_document_id").alias("left_document_id"), F.max("right_document_id").alias("right_document_id"), F.max_by("status", order).alias("status"), F.max_by("error", order).alias("error"), F.max("result").alias("result"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def _place(path: str, key: str) -> str:
    return f"{path}/{hashlib.sha256(key.encode()).hexdigest()}"


def cache_set(spark: SparkSession, path: str, key: str, value: bytes) -> None:
    """Keep bytes under a key, each key in a folder of its own."""
    spark.createDataFrame([(bytearray(value),)], "value binary").write.mode("overwrite").parquet(_place(path, key))


def cache_get(spark: SparkSession, path: str, key: str) -> bytes | None:
    """The bytes under a key, None where there are none."""
    if not exists(spark, _place(path, key)):
        return None
    rows = spark.read.schema("value binary").parquet(_place(path, key)).take(1)
    return bytes(rows[0].value) if rows else None


def cache_delete(spark: SparkSession, path: str, key: str) -> None:
    remove(spark, _place(path, key))


#: Progress of the steps of an ingest, and the classes of its errors.
STEPS = (("queued", 0.1), ("downloading", 0.25), ("extracting", 0.45), ("saving", 0.7), ("indexing", 0.85), ("completed", 1.0))
ERRORS = ("recognition", "storage", "validation", "unknown")


def extraction_progress(done, total):
    """Progress while pages are recognised: from that of extracting towards that of saving."""
    return F.least(F.lit(0.7), F.lit(0.45) + F.lit(0.25) * done / F.greatest(total, F.lit(1)))


def error_class(error) -> str:
    """What kind of error stopped an ingest."""
    name = type(error).__name__.lower()
    if isinstance(error, (ValueError, TypeError)):
        return "validation"
    if isinstance(error, OSError):
        return "storage"
    return "recognition" if "ocr" in name or "parse" in name or "timeout" in name else "unknown"


def page_tables(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, table_no, page, rows, columns, shape) of the tables found on parsed pages; the last parse of a page counts."""
    once = I.latest(pages, ["document_id", "page_number"], F.desc_nulls_last("parsed_at"), F.desc_nulls_last("text"))
    each = once.select("document_id", "page_number", F.posexplode("page_tables").alias("table_no", "t"))
    number = lambda k: F.try_to_number(F.nullif(F.regexp_extract("t.shape", r"(\d+)\D+(\d+)", k), F.lit("")), F.lit("999999")).cast("int")
    return each.select("document_id", "page_number", "table_no", F.col("t.page").alias("page"), number(1).alias("rows"), number(2).alias("columns"), F.col("t.shape").alias("shape"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(document_id, filename, total_pages, page_number, chars, words) of parsed pages, the last parse of each."""
    once = I.latest(pages, ["document_id", "page_number"], F.desc_nulls_last("parsed_at"), F.desc_nulls_last("text"))
    return once.select("document_id", "filename", "total_pages", "page_number", F.char_length("text").alias("chars"), F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+"), 0)).alias("words"))


@dataclass(frozen=True)
class Settings:
    """Settings of the engine; each is read from QUILL_<NAME> where that is set. Lists are separated by commas."""

    index_name: str = "default"
    top_k: int = 10
    pages_per_request: int = 12
    pdf_bytes: int = 50 << 20
    image_bytes: int = 10 << 20
    query_chars: int = 8192
    strategies: tuple[str, ...] = ("baseline", "lexical", "semantic", "hybrid", "rg")

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        """Settings of the environment; a value that can't be read leaves the default."""
        found = {}
        for f in fields(cls):
            raw = env.get(f"QUILL_{f.name.upper()}")
            if raw is None or not raw.strip():
                continue
            if isinstance(f.default, tuple):
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            elif isinstance(f.default, int):
                try:
                    found[f.name] = int(raw)
                except ValueError:
                    continue
            else:
                found[f.name] = raw.strip()
        return cls(**found)
