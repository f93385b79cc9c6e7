"""Stored learner progress (D11): one nested map per learner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import gates
from lectern.sinks import tables

QUESTIONS = "struct<questions: array<struct<question: string, attempts: bigint, correct: bigint>>>"
PROGRESS = f"map<string, map<string, map<string, {QUESTIONS}>>>"


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """``progress_<user>.json`` files as (user_id, progress); a bad file gives a null map."""
    files = spark.read.option("pathGlobFilter", "progress_*.json").text(root, wholetext=True)
    user = F.regexp_extract(F.col("_metadata.file_name"), r"progress_(.*)\.json$", 1)
    return files.select(user.alias("user_id"), F.from_json("value", PROGRESS).alias("progress"))


def explode_progress(saved: DataFrame) -> DataFrame:
    """Attempt counts from nested progress; learners without progress give no rows."""
    return (
        saved.select("user_id", F.explode("progress").alias("subject", "_t"))
        .select("user_id", "subject", F.explode("_t").alias("topic", "_c"))
        .select("user_id", "subject", "topic", F.explode("_c").alias("concept", "_q"))
        .select("user_id", "subject", "topic", "concept", F.explode("_q.questions").alias("q"))
        .select("user_id", "subject", "topic", "concept", "q.question", "q.attempts", "q.correct")
    )


def nest_progress(counts: DataFrame) -> DataFrame:
    """The inverse: one nested map per learner, level by level.

    Each level groups by learner and path, so a group holds one learner's share
    of the catalogue at most.
    """

    def level(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("_v"))

    leaf = counts.groupBy("user_id", "subject", "topic", "concept").agg(
        F.struct(F.array_sort(F.collect_list(F.struct("question", "attempts", "correct"))).alias("questions")).alias("_v")
    )
    concepts = level(leaf, ["user_id", "subject", "topic"], "concept", "_v")
    topics = level(concepts, ["user_id", "subject"], "topic", "_v")
    return level(topics, ["user_id"], "subject", "_v").withColumnRenamed("_v", "progress")


def save_progress(saved: DataFrame, path: str) -> None:
    """K6: insert or replace whole learners; (user_id, progress, saved_at)."""
    tables.upsert(saved, path, ["user_id"], ["saved_at"])


def reset_progress(users: DataFrame, path: str) -> None:
    """K6: an empty map replaces what was saved. ``users``: user_id, saved_at."""
    save_progress(users.withColumn("progress", F.from_json(F.lit("{}"), PROGRESS)).select("user_id", "progress", "saved_at"), path)


def export_progress(saved: DataFrame) -> DataFrame:
    """K6: learner and JSON text."""
    return saved.select("user_id", F.to_json("progress").alias("json"))


def import_progress(documents: DataFrame, path: str) -> DataFrame:
    """K6: save valid documents (user_id, json, saved_at); return the rejected ones.

    A document is rejected when it is too large (P13) or not progress JSON.
    """
    parsed = documents.withColumn("progress", F.from_json("json", PROGRESS))
    good = gates.payload_fits(F.col("json")) & F.col("progress").isNotNull()
    save_progress(parsed.where(good).select("user_id", "progress", "saved_at"), path)
    return parsed.where(~good).select("user_id", "saved_at")
