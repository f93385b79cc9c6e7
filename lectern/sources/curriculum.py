"""Curriculum files (D1): nested JSON to one row per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.layout import written

QUESTION = "struct<question: string, acceptable_answers: array<string>, hints: array<string>>"
CONCEPT = f"struct<name: string, summary: string, steps: array<string>, questions: array<{QUESTION}>>"
DEPTH = 4


def node_schema(depth: int = DEPTH) -> str:
    """DDL of a topic or subtopic with ``depth`` levels below it; what lies deeper stays as JSON text until it is asked for."""
    below = "string"
    for _ in range(depth + 1):
        below = f"struct<name: string, concepts: array<{CONCEPT}>, subtopics: array<{below}>>"
    return below


def content_schema(depth: int = DEPTH) -> str:
    """DDL of a curriculum."""
    return f"struct<subject: string, grade: string, topics: array<{node_schema(depth)}>>"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """S3: the JSON files at ``root`` and the ``content.json`` of each folder in it, as (path, value)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    inner = F.regexp_replace(path, r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    flat = ~inner.contains("/")
    return files.select(path.alias("path"), "value", flat.alias("flat")).where(
        flat | inner.rlike(r"^[^/]+/content\.json$")
    )


def load(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """S3: (subject, grade, topics, path), the later file of a subject winning.

    The subject of a flat file is its ``subject`` field or its name; that of a
    nested file is its folder. Nested files come after flat ones. A file that is
    not JSON is skipped. ``files``: path, value and flat.
    """
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")

    def named(doc: str) -> Column:
        return F.when(F.col("flat"), F.coalesce(f"{doc}.subject", stem)).otherwise(F.element_at(parts, -2))

    # Who wins is decided on names alone. The one-element explode keeps the optimiser from repeating the parse per field;
    # whether there are topics is asked only of a file that has neither subject nor grade.
    topics = F.from_json("value", "struct<topics: string>")["topics"]
    head = F.explode(F.array(F.from_json("value", "struct<subject: string, grade: string>"))).alias("h")
    read = F.col("h.subject").isNotNull() | F.col("h.grade").isNotNull() | topics.isNotNull()
    heads = files.select("path", "flat", "value", head)
    names = written(heads.select(named("h").alias("subject"), "path", "flat", read.alias("read")), "names")
    last = F.max_by("path", F.struct((~F.col("flat")).alias("nested"), F.col("path")))
    winners = written(names.where("read").groupBy("subject").agg(last.alias("path")).where("path IS NOT NULL"), "winners")
    # A file whose path wins by the file's own name, and by no other, is parsed where it lies. Only the rest is joined:
    # paths that lose, and paths with several files or names.
    own = names.where("path IS NOT NULL").groupBy("path").agg(
        F.min("read").alias("read"), F.min(F.struct("subject")).alias("least"), F.max(F.struct("subject")).alias("most")
    )
    won = winners.groupBy("path").agg(F.collect_list(F.struct("subject")).alias("won"))
    plain = F.col("read") & (F.col("least") == F.col("most")) & (F.size("won") == 1) & (F.col("least") == F.get("won", F.lit(0)))
    rest = written(own.join(won, "path", "left").where(~F.coalesce(plain, F.lit(False))).select("path", "won"), "rest")
    doc = F.explode(F.array(F.from_json("value", content_schema(depth)))).alias("doc")
    if winners.count() < rest.count():
        return files.join(winners, "path").select("subject", "path", doc).select("subject", "doc.grade", "doc.topics", "path")
    here = files.where("path IS NOT NULL").join(rest, "path", "left_anti").select("path", "flat", "value", doc)
    # A document that could not be read whole may lack its subject.
    field = F.coalesce("doc.subject", F.from_json("value", "struct<subject: string>")["subject"], stem)
    plain_rows = here.select(
        F.when(F.col("flat"), field).otherwise(F.element_at(parts, -2)).alias("subject"), "doc.grade", "doc.topics", "path"
    )
    shared = rest.where("won IS NOT NULL").select("path", F.explode("won").alias("w")).select("path", "w.subject")
    if not shared.limit(1).count():
        return plain_rows
    named_rows = files.join(shared, "path").select("subject", "path", doc).select("subject", "doc.grade", "doc.topics", "path")
    return plain_rows.unionByName(named_rows)
