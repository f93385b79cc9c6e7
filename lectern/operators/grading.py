"""Grading attempts against an answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import similarity
from lectern.operators.layout import spread_small


def grade(attempts: DataFrame, key: DataFrame, ratio: float = lexicon.GRADING_RATIO) -> DataFrame:
    """Whether an answer equals, or is similar over ``ratio`` to, an accepted one.

    ``attempts``: question, answer and anything else. ``key``: question,
    acceptable_answers. Each distinct (question, answer) is judged once; equal
    answers and pairs too different in length never reach Python.
    """
    said = attempts.select("question", F.lower("answer").alias("_a")).distinct()
    accepted = key.select("question", F.explode("acceptable_answers").alias("k")).select("question", F.lower("k").alias("_k")).distinct()
    pairs = said.join(accepted, "question").withColumn("_exact", F.col("_a") == F.col("_k"))
    near = ~F.col("_exact") & similarity.length_can_reach(F.col("_a"), F.col("_k"), ratio)
    measured = similarity.similarity_ratio(F.when(near, F.col("_a")), F.when(near, F.col("_k")))
    judged = spread_small(pairs).withColumn("_r", measured).groupBy("question", "_a").agg(
        F.bool_or(F.col("_exact") | F.coalesce(F.col("_r") > ratio, F.lit(False))).alias("correct")
    )
    graded = attempts.withColumn("_a", F.lower("answer")).join(judged, ["question", "_a"], "left")
    return graded.withColumn("correct", F.coalesce("correct", F.lit(False))).drop("_a")
