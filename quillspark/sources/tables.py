"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; columns are pruned at the scan by later selects."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
