"""Queries over quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units
from ..session import materialize
from ..sources.tables import table

BARE = r"^[-−+\d\s.,'’eE\u00a0\u202f\u2009]+$"


def padded(number: Column, width: int) -> Column:
    """Digits padded with zeros to ``width``, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def fact_quantities(spark: SparkSession, folder: str) -> DataFrame:
    """Every quantity of normalized_facts with its kind and value in the kind's unit.

    A fact whose raw value is a bare number takes the unit that the content of its evidence
    unit gives in a bracket behind that number.
    """
    names = ["fact_id", "document_id", "subject_key", "evidence_id", "field_type", "raw_value", "normalized_value"]
    facts = table(spark, folder, "normalized_facts").select(*names).where("field_type in ('amount', 'duration', 'measure', 'rate')").distinct()
    text = F.coalesce("raw_value", "normalized_value")
    bare = facts.where(text.rlike(BARE)).withColumn("number", F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f\u2009]+", " ")))
    notes = units.unit_notes(table(spark, folder, "evidence_units").select("evidence_id", "content").where(F.col("content").rlike(r"[(\[]")), "evidence_id", "content")
    noted = bare.join(notes, ["evidence_id", "number"], "left").drop("number")
    plain = facts.where(~F.coalesce(text.rlike(BARE), F.lit(False))).withColumn("note", F.lit(None).cast("string"))
    return units.with_quantity(noted.select(*names, "note").unionByName(plain.select(*names, "note")), "raw_value", F.col("field_type"), "note", "normalized_value")


def amount_quantities(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry of normalized_fields.amounts with its kind and value."""
    rows = table(spark, folder, "normalized_fields").select("fields_id", "unit_note", F.posexplode("amounts").alias("position", "amount")).distinct()
    return units.with_quantity(rows, "amount", "amount", "unit_note")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of quantities that agree after conversion."""
    facts = fact_quantities(spark, folder).where("document_id is not null and subject_key is not null")
    facts = facts.select(F.struct(F.lit("fact").alias("of"), F.col("document_id").alias("a"), F.col("subject_key").alias("b")).alias("scope"), F.concat(F.lit("f"), padded(F.col("fact_id"), 10)).alias("item"), "kind", "value")
    fields = F.concat(F.lit("n"), padded(F.col("fields_id"), 10))
    amounts = amount_quantities(spark, folder).select(F.struct(F.lit("amounts").alias("of"), fields.alias("a"), F.lit("").alias("b")).alias("scope"), F.concat(fields, F.lit("#"), padded(F.col("position"), 2)).alias("item"), "kind", "value")
    items = materialize(facts.unionByName(amounts).where("kind is not null"), "quantities")
    return units.agreeing_pairs(items).select(F.col("scope.of").alias("kind"), "left_key", "right_key")


def p3_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with their converted values."""
    return fact_quantities(spark, folder).select("fact_id", "raw_value", "kind", "value")


def p3_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts with their converted values."""
    return amount_quantities(spark, folder).select("fields_id", "position", "amount", "kind", "value")


QUERIES: dict = {"p3_found": p3_found, "p3_facts": p3_facts, "p3_amounts": p3_amounts}
ORACLE: dict = {}
