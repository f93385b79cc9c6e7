"""Corpus to chunk table: cut, number, encode, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import chunking, vectors
from lectern.operators.layout import spread_small


def chunk_documents(docs: DataFrame, text: str = "text", keep_failures: bool = True, **size) -> DataFrame:
    """S9 + F25: one row per chunk. A document without text becomes a row with an ``error``.

    Every other column of ``docs`` is carried along on the JVM side.
    """
    cols = [c for c in docs.columns if c != text]
    cut = spread_small(docs).withColumn("_chunks", chunking.chunks_of(F.col(text), **size))
    explode = F.explode_outer if keep_failures else F.explode
    return cut.select(
        *cols, F.when(F.col(text).isNull(), "no text").alias("error"), explode("_chunks").alias("c")
    ).select(*cols, "error", "c.*")


def chunk_key(collection: Column, doc: Column, ordinal: Column) -> Column:
    """The document is part of the id, so two files never overwrite each other."""
    return F.concat_ws("_", collection, doc.cast("string"), ordinal.cast("string"))


def encode_chunks(chunks: DataFrame, text: str = "text", **encoder) -> DataFrame:
    """K3 + F26: chunk rows with their embedding."""
    return chunks.withColumn("embedding", vectors.encoder_udf(**encoder)(F.col(text)))


def run_summary(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents processed, chunks made, documents failed."""
    per_doc = chunks.groupBy(doc).agg(
        F.count("chunk_id").alias("n"), F.bool_or(F.col("error").isNotNull()).alias("bad")
    )
    return per_doc.agg(
        F.count_if(~F.col("bad")).alias("processed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.count_if("bad").alias("failed"),
    )


def failures(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    return chunks.where(F.col("error").isNotNull()).select(doc, "error")


def chunks_per_collection(chunks: DataFrame) -> DataFrame:
    """A11"""
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


def merge_intervals(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching closed spans of one key become one.

    A new island starts where a span begins after every earlier end.
    """
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        spans.withColumn("_fresh", fresh).withColumn("_island", island)
        .groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def chunk_file(chunks: DataFrame, stem: Column, meta: Column) -> DataFrame:
    """K2: file name and headed text of each chunk; ``meta`` is a string map."""

    def told(key: str) -> Column:
        return F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit("unknown"))

    header = F.concat_ws(
        "\n",
        F.concat(F.lit("# Chunk "), F.col("chunk_id").cast("string")),
        F.concat(F.lit("# Source: "), told("source_file")),
        F.concat(F.lit("# Grade: "), told("grade")),
        F.concat(F.lit("# Subject: "), told("subject")),
        F.concat(F.lit("# Chapter: "), told("chapter")),
        F.concat(F.lit("# Position: "), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string")),
        F.lit(""),
        F.col("text"),
    )
    return chunks.withColumns(
        {"file_name": F.format_string("%s_chunk_%03d.txt", stem, F.col("chunk_id")), "file_text": header}
    )
