"""Thin views that give the driver tables the shape of the library's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; zone-free timestamps are taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return attempts_of(table(spark, folder, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    k = F.col("k")
    # k is its own projection, so the JSON is read once per row and not once per use.
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        "event_id", "ts", "user_id",
        F.col("event_type").alias("subject"),
        F.concat(F.lit("t"), (k % 5 % 2).cast("string")).alias("topic"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("concept"),
        F.concat(F.lit("q"), (k % 10).cast("string")).alias("question"),
        (F.col("value") >= 35.0).alias("correct"),
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return attempts(spark, folder).select("subject", "topic", "concept", "question").distinct()


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions_of(table(spark, folder, "conversations"))


def questions_of(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(said, ["conv_id", "turn"])


def messy_questions(spark: SparkSession, folder: str) -> DataFrame:
    return messy_of(table(spark, folder, "conversations"))


def messy_of(turns: DataFrame) -> DataFrame:
    text = F.col("question")
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 8
    prefix = {
        3: ("Explain in brief ", text),
        4: ("please explain ", text),
        5: ("why does DNA need ", text),
        6: ("difference between ", text),
        0: ("hey can u tell me what is ", F.lower(text)),
        1: ("so like what happens when the switch meets ", F.lower(text)),
    }
    made = F.when(kind == 2, F.upper(F.replace(text, F.lit("ß"), F.lit("ss"))))
    for n, (head, tail) in prefix.items():
        made = made.when(kind == n, F.concat(F.lit(head), tail))
    return questions_of(turns).select("conv_id", "turn", made.otherwise(text).alias("question"))


def keyword_entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_of(table(spark, folder, "documents"))


def corpus_of(documents: DataFrame) -> DataFrame:
    grade = 8 + F.col("doc_id") % 5
    return documents.select(
        "doc_id",
        F.concat(F.lit("neb_"), "lang", F.lit("_grade_"), grade.cast("string")).alias("collection"),
        F.col("lang").alias("subject"),
        grade.alias("grade"),
        "source", "text",
    )


def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return (
        table(spark, folder, "embeddings")
        .join(docs, "vec_id")
        .select(
            "vec_id",
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
            "embedding",
            "text",
        )
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every fiftieth vector, so queries grow with the store they are put to."""
    return (
        table(spark, folder, "embeddings")
        .where(F.col("vec_id") % 50 == 0)
        .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    )


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 5).alias("doc_id"),
        (F.col("page_id") % 5).cast("int").alias("page_no"),
        F.col("html").alias("text"),
    )


# The same views for DuckDB, as common table expressions.
SQL_VIEWS = {
    "attempts": """
        SELECT event_id, ts, user_id, event_type AS subject,
               concat('t', CAST(k % 5 % 2 AS VARCHAR)) AS topic, concat('c', CAST(k % 5 AS VARCHAR)) AS concept,
               concat('q', CAST(k % 10 AS VARCHAR)) AS question, value >= 35.0 AS correct
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e""",
    "catalogue": "SELECT DISTINCT subject, topic, concept, question FROM attempts",
    "questions": "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'",
    "answers": """
        SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "messy": """
        SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 8
            WHEN 0 THEN concat('hey can u tell me what is ', lower(text))
            WHEN 1 THEN concat('so like what happens when the switch meets ', lower(text))
            WHEN 2 THEN upper(replace(text, 'ß', 'ss'))
            WHEN 3 THEN concat('Explain in brief ', text)
            WHEN 4 THEN concat('please explain ', text)
            WHEN 5 THEN concat('why does DNA need ', text)
            WHEN 6 THEN concat('difference between ', text)
            ELSE text END AS question
        FROM conversations WHERE role = 'user'""",
    "entries": "SELECT item_id AS id, text AS title FROM benchmark",
    "corpus": """
        SELECT doc_id, concat('neb_', lang, '_grade_', CAST(8 + doc_id % 5 AS VARCHAR)) AS collection,
               lang AS subject, 8 + doc_id % 5 AS grade, source, text FROM documents""",
    "store": """
        SELECT vec_id, concat('c', CAST(label AS VARCHAR)) AS collection, embedding, text
        FROM embeddings JOIN documents ON doc_id = vec_id""",
    "query_vectors": """
        SELECT vec_id AS query_id, embedding AS query_embedding FROM embeddings WHERE vec_id % 50 = 0""",
    "page_text": """
        SELECT page_id // 5 AS doc_id, CAST(page_id % 5 AS INTEGER) AS page_no, html AS text FROM pages""",
}

_NEEDS = {"catalogue": ["attempts"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """The ``WITH`` prefix that defines the named views."""
    ordered: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
