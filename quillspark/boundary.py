"""What stands for services that aren't part of the engine: recognisers, encoders, judges.

Each has an offline form that gives the same result for the same rows.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.search import encode_text


class Encoder(Protocol):
    def encode(self, df: DataFrame, text: str) -> DataFrame: ...


class Judge(Protocol):
    def judge(self, df: DataFrame) -> DataFrame: ...


class HashEncoder:
    """Vectors of hashed trigrams."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, df: DataFrame, text: str) -> DataFrame:
        return encode_text(df, text, self.width)


class LocalJudge:
    """Keeps the local decision; rows that need a judge are marked as not judged."""

    def judge(self, df: DataFrame) -> DataFrame:
        return df.withColumn("judged_by", F.when(F.col("needs_judge"), "none").otherwise("local"))


def detection_prompt(claim: str, context: str, conflicts: str):
    """A column with what a judge is asked about a claim."""
    return F.concat_ws("\n", F.concat(F.lit("Claim: "), F.col(claim)), F.concat(F.lit("Conflicts: "), F.array_join(F.col(conflicts), ", ")), F.lit("Evidence:"), F.col(context))


def parsed_answer(answer: str, schema: str):
    """The JSON of an answer, also where it stands within other text; null where there is none."""
    inner = F.regexp_extract(F.col(answer), r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(inner != "", inner), schema)
