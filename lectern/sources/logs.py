"""Feedback logs (D10) as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FEEDBACK = (
    "timestamp string, user_id string, original string, corrected string, clean string, "
    "confidence double, notes array<string>, corrupt string"
)


def read_feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row per JSON line. Blank lines are skipped, broken ones kept in ``corrupt``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(FEEDBACK).option("columnNameOfCorruptRecord", "corrupt").json(path)
