"""Attempts to learner progress, student reports and class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.operators.layout import number_rows

QUESTION_KEY = ["subject", "topic", "concept", "question"]
CONCEPT_KEY = ["subject", "topic", "concept"]


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """A1: attempts and correct answers per learner and question. Same on a stream."""
    return attempts.groupBy("user_id", *QUESTION_KEY).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("correct").alias("correct")
    )


def mastered(correct: Column) -> Column:
    return correct >= lexicon.MASTERED_CORRECT


def weak(attempts: Column, correct: Column) -> Column:
    return (attempts >= 2) & (correct == 0)


def catalogue_progress(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every catalogue question with each learner's counts, 0/0 where nobody tried it."""
    return catalogue.join(counts, QUESTION_KEY, "left").withColumns(
        {"attempts": F.coalesce("attempts", F.lit(0)), "correct": F.coalesce("correct", F.lit(0))}
    )


def known_counts(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counts of catalogue questions only."""
    return counts.join(catalogue.select(*QUESTION_KEY).distinct(), QUESTION_KEY, "left_semi")


def weak_questions(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue questions a learner tried at least twice and never got right."""
    tried = counts.where(weak(F.col("attempts"), F.col("correct")))
    return known_counts(tried, catalogue).select("user_id", *QUESTION_KEY, "attempts")


def student_report(counts: DataFrame, catalogue: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """A2: totals over the catalogue per learner.

    Questions a learner never met add nothing but to the number of questions,
    which is the size of the catalogue. So learners x catalogue is never formed.
    """
    total = catalogue.agg(F.count(F.lit(1))).scalar()
    items = catalogue.select(*QUESTION_KEY).distinct().withColumn("_known", F.lit(True))
    known = F.coalesce("_known", F.lit(False))
    tries, right = F.when(known, F.col("attempts")).otherwise(0), F.when(known, F.col("correct")).otherwise(0)
    sums = counts.join(items, QUESTION_KEY, "left").groupBy("user_id").agg(
        F.sum(tries).alias("total_attempts"),
        F.sum(right).alias("total_correct"),
        F.count_if(mastered(right)).alias("mastered_questions"),
        F.count_if(weak(tries, right)).alias("weak_questions"),
    )
    measures = ["total_attempts", "total_correct", "mastered_questions", "weak_questions"]
    if users is not None:
        sums = users.select("user_id").distinct().join(sums, "user_id", "left").na.fill(0, measures)
    return sums.select("user_id", total.alias("total_questions"), *measures)


def class_report(reports: DataFrame, by: list[str] = ()) -> DataFrame:
    """A3: number of students and means, over all rows or per class."""
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_students"),
        F.avg("mastered_questions").alias("average_mastered_questions"),
        F.avg("total_correct").alias("average_total_correct"),
    )


def class_weak_concepts(weak_rows: DataFrame, students: DataFrame, share: float = 0.3) -> DataFrame:
    """A4: concepts weak for a share of the class.

    ``questions`` counts weak questions over all students (the threshold is on
    it); ``students`` counts distinct students.
    """
    n = students.agg(F.count_distinct("user_id")).scalar()
    return (
        weak_rows.groupBy(*CONCEPT_KEY)
        .agg(F.count(F.lit(1)).alias("questions"), F.count_distinct("user_id").alias("students"))
        .where(F.col("questions") >= F.greatest(F.lit(1), F.floor(n * F.lit(share))))
    )


def learner_summary(counts: DataFrame) -> DataFrame:
    """A5: totals of each learner's own progress; a concept with a mastered question counts once."""
    concept = F.struct(*CONCEPT_KEY)
    return counts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.sum("attempts").alias("total_attempts"),
        F.sum("correct").alias("total_correct"),
        F.count_distinct(F.when(mastered(F.col("correct")), concept)).alias("mastered_concepts"),
        F.count_if(weak(F.col("attempts"), F.col("correct"))).alias("weak_questions"),
    )


def subject_summary(counts: DataFrame) -> DataFrame:
    """A5: the same per subject."""
    return counts.groupBy("user_id", "subject").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("correct").alias("correct"),
        F.count_if(mastered(F.col("correct"))).alias("mastered"),
    )


def accuracy_mastery(counts: DataFrame) -> DataFrame:
    """Accuracy per concept, subject and learner, from one pass of grouping sets.

    ``level`` is concept, subject or user; ``band`` is set for concepts with at
    least five attempts: mastered from 80 %, weak below 50 %.
    """
    cols = ["user_id", *CONCEPT_KEY]
    sums = counts.groupingSets(
        [["user_id"], ["user_id", "subject"], cols], *cols
    ).agg(
        F.sum("attempts").alias("attempts"),
        F.sum("correct").alias("correct"),
        F.grouping_id(*cols).alias("_g"),
    )
    level = F.when(F.col("_g") == 0, "concept").when(F.col("_g") == 3, "subject").otherwise("user")
    score = F.col("correct") / F.col("attempts") * 100
    band = F.when((F.col("_g") == 0) & (F.col("attempts") >= 5), F.when(score >= 80, "mastered").when(score < 50, "weak"))
    return sums.select(*cols, level.alias("level"), "attempts", "correct", score.alias("score"), band.alias("band"))


def advice(levels: DataFrame) -> DataFrame:
    """The first weak concept to review, or praise, or a start."""
    concept = F.format_string("%s (%s)", F.col("concept"), F.col("topic"))
    first_weak = F.min_by(F.when(F.col("band") == "weak", concept), F.when(F.col("band") == "weak", F.struct(*CONCEPT_KEY)))
    any_mastered = F.bool_or(F.coalesce(F.col("band") == "mastered", F.lit(False)))
    return levels.groupBy("user_id").agg(first_weak.alias("_w"), any_mastered.alias("_m")).select(
        "user_id",
        F.when(F.col("_w").isNotNull(), F.concat(F.lit(lexicon.ADVICE_REVIEW), "_w"))
        .when(F.col("_m"), lexicon.ADVICE_MASTERED)
        .otherwise(lexicon.ADVICE_START).alias("advice"),
    )


def concept_mastery(counts: DataFrame) -> DataFrame:
    """Whole percent of a concept's tried questions that were ever answered right."""
    right = F.count_if(F.col("correct") > 0)
    return counts.groupBy("user_id", *CONCEPT_KEY).agg(
        F.count(F.lit(1)).alias("questions"),
        right.alias("answered_right"),
        F.floor(F.lit(100) * right / F.count(F.lit(1))).alias("mastery"),
    )


def next_concept(counts: DataFrame, catalogue: DataFrame, order: list[str] = CONCEPT_KEY) -> DataFrame:
    """Each learner's first catalogue concept with a question not yet mastered.

    Learners x catalogue is never formed. Concepts are numbered 0..n-1 in
    catalogue order; a learner's wholly mastered concepts are a few of those
    numbers, and the answer is the first number missing from them.
    """
    concepts = catalogue.groupBy(*CONCEPT_KEY).agg(
        F.count(F.lit(1)).alias("questions"), *[F.min(c).alias(f"_o{i}") for i, c in enumerate(order) if c not in CONCEPT_KEY]
    )
    sort = [F.col(c) if c in CONCEPT_KEY else F.col(f"_o{i}") for i, c in enumerate(order)]
    numbered = number_rows(concepts, sort)

    done = (
        known_counts(counts.where(mastered(F.col("correct"))), catalogue)
        .groupBy("user_id", *CONCEPT_KEY).agg(F.count(F.lit(1)).alias("_done"))
        .join(numbered, CONCEPT_KEY).where(F.col("_done") == F.col("questions"))
        .select("user_id", "number")
    )
    seen = F.row_number().over(Window.partitionBy("user_id").orderBy("number")) - 1
    gaps = done.withColumn("_seen", seen).groupBy("user_id").agg(
        F.count_if(F.col("number") == F.col("_seen")).alias("number")
    )
    return (
        counts.select("user_id").distinct().join(gaps, "user_id", "left")
        .withColumn("number", F.coalesce("number", F.lit(0)))
        .join(numbered, "number")
        .select("user_id", *CONCEPT_KEY)
    )


def next_tried_concept(counts: DataFrame) -> DataFrame:
    """J9 without a catalogue: the first concept of the learner's own progress left unmastered."""
    first = F.min(F.struct(*CONCEPT_KEY)).alias("c")
    return counts.where(~mastered(F.col("correct"))).groupBy("user_id").agg(first).select("user_id", "c.*")
