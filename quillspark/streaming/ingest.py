"""Streams of OCR responses and status rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import ingest as I
from ..session import scratch


def table_stream(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A table of a data folder as a stream of its files, with the schema it has."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # as a pattern, so that the table may be one file or a folder of them
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[t]")


def units_stream(responses: DataFrame, out: str, checkpoint: str, **trigger):
    """Evidence units of arriving OCR responses, in a table that `current_units` reads.

    A batch is written in a folder of its own number, so a batch that is run again after a
    failure replaces what it wrote. Every unit carries the run it is from, and a document's last
    run of a batch leaves a mark even if it has no unit, so that units of an older run are
    replaced, whichever batch either came in.
    """

    def write(batch: DataFrame, number: int) -> None:
        runs = I.latest_runs(batch).persist()
        stamp = runs.select("document_id", F.col("created").alias("run_created"), F.col("id").alias("run_id"))
        units = stamp.join(I.evidence_units(runs), "document_id", "left")
        units.select(*UNIT_NAMES).write.mode("overwrite").parquet(f"{out}/batch={number}")
        runs.unpersist()

    return responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


UNITS = "document_id string, run_created long, run_id string, evidence_id string, content string, source_type string, page_number int"
UNIT_NAMES = [x.split()[0] for x in UNITS.split(", ")]


def current_units(spark: SparkSession, out: str) -> DataFrame:
    """The units of the last run of each document among all batches: older runs, also those that came late, are left out."""
    rows = spark.read.schema(f"{UNITS}, batch long").parquet(out)
    # a few columns are grouped by document, so a large document is no more than its last run here
    last = rows.groupBy("document_id").agg(F.max(F.struct("run_created", "run_id")).alias("_last"))
    same = rows.join(last, "document_id").where(F.struct("run_created", "run_id").eqNullSafe(F.col("_last")))
    # a run that was delivered in two batches counts once
    first = same.groupBy("document_id", "run_id").agg(F.min("batch").alias("batch"))
    return same.join(first, ["document_id", "run_id", "batch"], "left_semi").where("evidence_id is not null").select("evidence_id", "document_id", "content", "source_type", "page_number")


def compacted(spark: SparkSession, out: str, to: str) -> None:
    """Write the current units as one table, so that superseded ones take no more room."""
    current_units(spark, out).repartition("document_id").write.mode("overwrite").parquet(to)


def status_counts(log: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Status rows by window of arrival, late ones within ``late``; rows without arrival are left out."""
    rows = log.where("arrived_at is not null").withColumn("arrived", F.col("arrived_at").cast("timestamp")).withWatermark("arrived", late)
    return rows.groupBy(F.window("arrived", window).alias("w"), F.lower("status").alias("status")).agg(F.count("*").alias("updates"), F.max("progress").alias("progress")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status", "updates", "progress")


def drained(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Run a stream over what there is, in update mode, and read the last result of each of ``keys``.

    In update mode the state of a window is dropped once the watermark has passed it; each batch
    writes the rows that changed, and the last batch counts.
    """
    spark = df.sparkSession
    base = scratch(spark, f"stream_{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/result")
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in others]).select(*df.columns)


def arrived_units(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The evidence units that a stream over all OCR responses wrote."""
    base = scratch(spark, "stream_units")
    units_stream(table_stream(spark, folder, "ocr_responses", files), f"{base}/units", f"{base}/checkpoint").awaitTermination()
    return current_units(spark, f"{base}/units")
