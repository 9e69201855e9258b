"""Reading and writing of JSON lines, documents and OCR responses as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I

#: The nested shape of an OCR response.
OCR_SCHEMA = (
    "id string, document_id string, filename string, created bigint, model string, md_results string, "
    "layout_details array<array<struct<index:int,label:string,bbox_2d:struct<x1:double,y1:double,x2:double,y2:double>,content:string>>>, "
    "data_info struct<pages:array<struct<width:int,height:int>>>, token_usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, request_id string"
)
#: Largest files that are read, in bytes, by kind.
LARGEST = {"pdf": 50 << 20, "image": 10 << 20}


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """OCR responses from JSON files, one or many lines each; lines that aren't objects give no row."""
    rows = spark.read.schema(OCR_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where("id is not null or md_results is not null or layout_details is not null")


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and lines that aren't objects are skipped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def largest(mime: Column) -> Column:
    """The largest size of a file of its kind, in bytes."""
    return F.when(F.startswith(mime, F.lit("image/")), F.lit(LARGEST["image"])).otherwise(F.lit(LARGEST["pdf"]))


def limited_url(content: Column, mime: Column) -> Column:
    """The content as a data address, null where it is over the limit of its kind."""
    return I.data_url(content, mime, largest(mime))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(filename, mime, bytes, content) of files; those over the limit of their kind are left out."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("filename"), I.mime_type(name).alias("mime"), F.col("length").alias("bytes"), "content")
    return rows.where(F.col("bytes") <= largest(F.col("mime")))


def save_index(postings: DataFrame, path: str, name: str) -> None:
    """Postings of a named index as a partition of a table, sorted within files so that a scan skips to what it needs."""
    key = "trigram" if "trigram" in postings.columns else "token"
    postings.withColumn("index_name", F.lit(name)).repartition(key).sortWithinPartitions(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_name").parquet(path)


def load_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("index_name") == name).drop("index_name")


def delete_where(df: DataFrame, condition: str, **values) -> DataFrame:
    """Rows that don't meet a condition with named values; rows for which it is null stay."""
    view = f"quill_delete_{abs(hash((condition, id(df))))}"
    df.createOrReplaceTempView(view)
    try:
        return df.sparkSession.sql(f"SELECT * FROM {view} WHERE NOT coalesce(({condition}), false)", args=values)
    finally:
        df.sparkSession.catalog.dropTempView(view)
