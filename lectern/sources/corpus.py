"""Text corpora: files, page tables, stored chunk files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.words import strip

TEXT_FILES = "*.{txt,md,jsonl}"


def read_corpus(spark: SparkSession, *roots: str, pattern: str = TEXT_FILES) -> DataFrame:
    """S1 + U4: path and whole text of every matching, non-blank file below the roots."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(list(roots), wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .where(strip(F.col("text")) != "")
    )


def path_metadata(path: Column) -> dict[str, Column]:
    """Grade, subject and collection name from a file path."""
    grade = F.regexp_extract(F.lower(path), r"(?:grade|class)_([0-9]+)", 1)
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.lower(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[^\p{L}\p{N}_]", ""))
    subject = F.replace(F.replace(stem, F.concat(F.lit("_grade_"), grade), F.lit("")), F.lit("neb_"), F.lit(""))
    known = grade != ""
    subject = F.when(known, subject).otherwise(F.replace(stem, F.lit("neb_"), F.lit("")))
    collection = (
        F.when(
            known & ~F.contains(stem, F.concat(F.lit("grade_"), grade)),
            F.concat(F.lit("neb_"), subject, F.lit("_grade_"), grade),
        ).when(stem.startswith("neb_"), stem).otherwise(F.concat(F.lit("neb_"), stem))
    )
    return {
        "grade": F.when(known, grade).otherwise("unknown"),
        "subject": subject,
        "collection": collection,
    }


def route_by_density(pages: DataFrame, mode: str = "auto", pages_seen: int = 3, least: int = 100) -> DataFrame:
    """Text or scanned per document from the text on its first pages.

    ``pages``: doc_id, page_no, text. ``mode``: auto, force (all scanned) or
    never (all text).
    """
    fixed = {"force": F.lit("scanned"), "never": F.lit("text")}
    chars = F.sum(F.when(F.col("page_no") < pages_seen, F.length(strip(F.col("text")))).otherwise(0))
    found = pages.groupBy("doc_id").agg(chars.alias("text_chars"))
    auto = F.when(F.col("text_chars") < least, "scanned").otherwise("text")
    return found.withColumn("kind", fixed.get(mode, auto))


CHUNK_ITEMS = "array<struct<text: string, chunk_id: int, start_pos: int, end_pos: int, metadata: map<string,string>>>"


def chunk_file_items(files: DataFrame, content: str = "value") -> DataFrame:
    """One row per chunk of stored chunk files.

    A file is a list, an object with ``chunks``, or an object whose first
    list-valued key starts with something that has a ``text``.
    """
    raw = F.col(content)
    fields = F.map_entries(F.from_json(raw, "map<string,string>"))
    lists = F.filter(
        fields, lambda e: e["value"].startswith("[") & F.get_json_object(e["value"], "$[0].text").isNotNull()
    )
    named = F.get(F.filter(fields, lambda e: e["key"] == "chunks"), F.lit(0))["value"]
    chosen = F.when(F.ltrim(raw).startswith("["), raw).otherwise(
        F.coalesce(named, F.get(lists, F.lit(0))["value"])
    )
    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.explode(F.from_json(chosen, CHUNK_ITEMS)).alias("c")).select(*kept, "c.*")
