"""A batch of questions from raw text to ranked context and, with a model, answers.

The stages are the library's own operators in the order a question meets them:
canned replies, normalisation, the exact and the semantic cache, collection
choice, search, ranking under a budget, and the keyword catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import answers, catalogue, gates, normalise, vectors
from lectern.operators import cache, layout, retrieval

Generate = Callable[[list[str]], list[str]]


def prepare(questions: DataFrame, encoder=None, dim: int = 64) -> DataFrame:
    """Canned reply, clean text, intent, cache key and embedding of every question.

    ``questions``: request_id, question, subject, grade and us. The cache key
    comes from the raw text, the embedding from the clean one.
    """
    q = F.col("question")
    out = normalise.normalise_questions(questions.withColumn("reply", gates.canned_reply(q)))
    out = out.withColumn("key", normalise.answer_key(q, F.col("subject"), F.coalesce(F.col("grade").cast("string"), F.lit(""))))
    text = F.when(F.col("clean_question") != "", F.col("clean_question")).otherwise(q)
    return out.withColumn("embedding", vectors.encoder_udf(encoder, dim)(text))


def answer_sources(prepared: DataFrame, fills: DataFrame, entries: DataFrame, threshold: float = 0.88) -> DataFrame:
    """Adds ``source``: edge_case, exact_cache, semantic_cache or rag_response, and the cached answer.

    ``fills``: key, us, value. ``entries``: entry_id, subject, grade, us,
    embedding, value. Each stage only sees what the ones before left over.
    """
    told = cache.exact_hits(prepared, fills).withColumnRenamed("value", "_exact")
    left = told.where(F.col("reply").isNull() & F.col("_exact").isNull())
    near = layout.written(cache.semantic_hits(left, entries, threshold).select("request_id", "entry_id"), "near")
    near = entries.select("entry_id", F.col("value").alias("_near")).join(near, "entry_id").drop("entry_id")
    return told.join(near, "request_id", "left").withColumns({
        "source": F.when(F.col("reply").isNotNull(), "edge_case").when(F.col("_exact").isNotNull(), "exact_cache")
        .when(F.col("_near").isNotNull(), "semantic_cache").otherwise("rag_response"),
        "answer": F.coalesce("reply", "_exact", "_near"),
    }).drop("_exact", "_near")


def gather_context(
    asked: DataFrame, chunks: DataFrame, collections: DataFrame, k: int = 2, budget: int = 400, **options
) -> DataFrame:
    """Context texts per question from its selected collections, primary sources first.

    Returns request_id, context (array), sources (array) and mean_score.
    """
    chosen = retrieval.select_collections(asked, collections).groupBy("request_id").agg(
        F.collect_set("collection").alias("collections")  # three at most
    )
    queries = layout.written(asked.join(chosen, "request_id").select(
        F.col("request_id").alias("query_id"), F.col("embedding").alias("query_embedding"), "collections"
    ), "queries")
    used = retrieval.retrieve_context(queries, chunks, k, budget, selected=True, **options)
    rows = F.array_sort(F.collect_list(F.struct("position", "text", "collection")))  # six at most
    return used.groupBy(F.col("query_id").alias("request_id")).agg(
        rows.alias("_r"), F.avg("final_score").alias("mean_score")
    ).select(
        "request_id", F.transform("_r", lambda r: r["text"]).alias("context"),
        F.transform("_r", lambda r: r["collection"]).alias("sources"), "mean_score",
    )


def generate_answers(prompts: DataFrame, make: Callable[[], Generate], batch: int = 16) -> DataFrame:
    """Run an injected model over a ``prompt`` column, once per Python worker; adds ``answer``."""
    schema = prompts.withColumn("answer", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            texts = list(rows["prompt"])
            done = [a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])]
            yield rows.assign(answer=done)

    return prompts.mapInPandas(run, schema)


def ask(
    questions: DataFrame, chunks: DataFrame, collections: DataFrame, fills: DataFrame, entries: DataFrame,
    make: Callable[[], Generate] | None = None, encoder=None, dim: int = 64, threshold: float = 0.88, **options,
) -> DataFrame:
    """The answer record (D7) of every question.

    Without a model the answer of an uncached question stays null and its
    confidence 0; the prompt is there for whoever runs one.
    """
    # Each stage is met several times by the next ones; write it once so no model runs twice.
    prepared = layout.written(prepare(questions, encoder, dim), "prepared")
    told = layout.written(answer_sources(prepared, fills, entries, threshold), "told")
    fresh = told.where(F.col("source") == "rag_response")
    context = gather_context(fresh, chunks, collections, **options)
    out = told.join(context, "request_id", "left").withColumns({
        "prompt": answers.build_prompt(F.col("clean_question"), F.array_join("context", "\n\n")),
        "diagram": catalogue.trigger_key(F.col("question")),
    })
    if make is not None:
        done = generate_answers(out.where(F.col("source") == "rag_response").select("request_id", "prompt"), make)
        made = done.select("request_id", answers.clean_answer(F.col("answer")).alias("_made"))
        out = out.join(made, "request_id", "left").withColumn("answer", F.coalesce("answer", "_made"))
    scored = answers.answer_confidence(F.col("answer"), F.col("clean_question"), F.col("mean_score"))
    return out.select(
        "request_id", "source", "answer", "clean_question", "intent", "context", "sources", "diagram", "prompt",
        F.when(F.col("answer").isNull(), 0.0).otherwise(scored).alias("confidence"),
    )
