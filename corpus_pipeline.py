"""The training-corpus pipeline: toxic documents go, one document of each group of near copies stays, repeated passages
go, sources are mixed to target weights, and what remains is encoded.

Every stage works on all rows that the one before kept, and all but the last return the
columns of ``documents``. Texts keep their form where a stage does not change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, mixing, near_dedup, passages, toxicity
from lectern.llm.storage import scratch, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "_llm_score").where("_llm_score < 0.5").drop("_llm_score")


KEY = "_llm_row"


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more) the row of least doc_id, nulls last, whether ids repeat or not."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias(KEY), *docs.columns), "rows")
    ids = rows.select(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY).alias("_llm_rank"))
    # Sketches, sets and bands are done with once the keys to keep are written.
    with scratch(spark):
        found = near_dedup.near_duplicates(rows.select(F.col(KEY).alias("doc_id"), "text"), percent=80)
        members = found.select(F.col("doc_id").alias(KEY), "component_id").join(ids, KEY)
        least = members.groupBy("component_id").agg(F.min("_llm_rank").alias("least"))
        kept = stored(least.select(F.col(f"least.{KEY}").alias(KEY)), "kept", keep=True)
    return rows.join(kept, KEY, "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that also stand in a row before; one that loses all its words goes.

    Rows are in order of doc_id, nulls last. Those that share one are told apart by their
    text, so a hot doc_id does not land in one task of the sort.
    """
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    rows = stored(ordered.select(F.monotonically_increasing_id().alias(KEY), *docs.columns), "rows")
    with scratch(spark):
        cut = passages.remove_repeats(rows.select(F.col(KEY).alias("doc_id"), "text")).where("n_removed > 0")
        cut = stored(cut.select(F.col("doc_id").alias("_llm_id"), F.col("text").alias("_llm_text")), "cut", keep=True)
    out = rows.join(cut, F.col(KEY) == F.col("_llm_id"), "left").where("_llm_id IS NULL OR _llm_text <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_llm_id").isNull(), F.col("n_chars")).otherwise(F.length("_llm_text")))
    return out.withColumn("text", F.coalesce("_llm_text", "text")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row per document and pass, with the words that the pass takes."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and of the decoded text."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("bpe", encode),
]

# Training, permutations and BPE are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
