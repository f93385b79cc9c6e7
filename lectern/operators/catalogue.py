"""Matching questions to a keyword catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import catalogue as cat
from lectern.operators.layout import written

QUESTION_TERMS = 5


def normalise_entries(entries: DataFrame) -> DataFrame:
    """F18 + U3 on entries (id, title and, where known, keywords, type, subject, grades)."""
    for name, kind in (("keywords", "array<string>"), ("type", "string"), ("subject", "string"), ("grades", "array<int>")):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    given = entries.withColumn("keywords", cat.with_keywords(F.col("keywords"), F.col("title"), F.col("type")))
    return given.withColumns(
        {"terms": cat.entry_terms(F.col("keywords"), F.col("title")), "subject": F.lower("subject")}
    )


def by_subject(entries: DataFrame) -> DataFrame:
    """(subject, id) of the index."""
    return entries.select("subject", "id")


def by_grade(entries: DataFrame) -> DataFrame:
    """(grade, id) of the index."""
    return entries.select(F.explode("grades").alias("grade"), "id")


def _subsets(terms: Column) -> Column:
    """Every non-empty subset of up to five sorted terms, each as joined text."""
    empty = F.array(F.array().cast("array<string>"))
    grown = F.aggregate(
        terms, empty,
        lambda acc, t: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < QUESTION_TERMS), lambda s: F.array_append(s, t))),
    )
    return F.transform(F.filter(grown, lambda s: F.size(s) > 0), lambda s: F.array_join(s, " "))


def _scopes(entries: DataFrame, by_subject: bool, by_grade: bool) -> DataFrame:
    """Each entry under every (subject, grade) filter it answers to; '' and -1 mean no filter."""
    if not by_subject:
        entries = entries.withColumn("subject", F.lit(""))
    if not by_grade:
        entries = entries.withColumn("grades", F.array().cast("array<int>"))
    any_ = lambda s, g: F.struct(s.alias("subject"), g.alias("grade"))
    subject, none, no_grade = F.coalesce("subject", F.lit("")), F.lit(""), F.lit(-1)
    grades = F.coalesce("grades", F.array().cast("array<int>"))
    listed = F.array_distinct(F.concat(
        F.array(any_(none, no_grade), any_(subject, no_grade)),
        F.transform(grades, lambda g: any_(none, g)), F.transform(grades, lambda g: any_(subject, g)),
    ))
    return entries.select("id", "terms", F.explode(listed).alias("s")).select("id", "terms", "s.*")


def held_subsets(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, subset) for every asked set of terms that an entry holds.

    Sets grow by one term a level: an entry that holds a set is looked up for the
    asked sets that have one more term, and kept if it holds that term. An entry
    with many terms so meets the sets that questions ask for, not all it could form.
    """
    postings = written(entries.select("id", F.explode("terms").alias("last")).distinct().join(
        asked.where("n = 1").select(F.col("subset").alias("last")), "last", "left_semi"
    ), "postings")
    level = postings.select("id", F.col("last").alias("subset"))
    found = level
    for n in range(2, QUESTION_TERMS + 1):
        grown = asked.where(F.col("n") == n).select("parent", "last", F.col("subset").alias("next"))
        level = level.join(grown, F.col("subset") == F.col("parent")).select("id", "last", F.col("next").alias("subset"))
        level = written(level.join(postings, ["id", "last"], "left_semi").select("id", "subset"), "held")
        if not level.limit(1).count():
            break
        found = found.unionByName(level)
    return found


def subset_index(scoped: DataFrame, subsets: DataFrame) -> DataFrame:
    """Smallest entry id for every scope and asked set of up to five terms that some entry holds.

    A set is a key, so "entry holds this set" is an equality. However many
    entries share a keyword, they fold into one row per set before the look-up.
    """
    parts = F.split("subset", " ")
    asked = written(subsets.distinct().select(
        "subset", F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ").alias("parent"),
        F.element_at(parts, -1).alias("last"), F.size(parts).alias("n"),
    ), "subsets")
    held = held_subsets(scoped.select("id", "terms"), asked)
    return held.join(scoped.select("id", "subject", "grade"), "id").groupBy("subject", "grade", "subset").agg(F.min("id").alias("id"))


def match_questions(
    questions: DataFrame, entries: DataFrame, text: str = "question", floor: float = lexicon.MATCH_FLOOR
) -> DataFrame:
    """J4 + W1: the best catalogue entry per question, ties by id, kept from ``floor`` on.

    The score only depends on how many of a question's at most five terms an
    entry holds. So the best entry is the one under the largest subset of the
    terms that the index knows: at most 31 look-ups per distinct set of terms,
    and never a row per question and entry. Optional columns ``subject`` and
    ``grade`` narrow the candidates (U2): an unknown value is ignored, and an
    empty intersection falls back to the whole catalogue.
    """
    has_subject, has_grade = ("subject" in questions.columns), ("grade" in questions.columns)
    scoped = _scopes(normalise_entries(entries), has_subject, has_grade)
    subject = F.lower("subject") if has_subject else F.lit("")
    grade = F.col("grade").cast("int") if has_grade else F.lit(-1)
    asked = questions.withColumns({
        "_terms": F.array_sort(F.array_distinct(cat.key_terms(F.col(text)))),
        "_subject": F.coalesce(subject, F.lit("")), "_grade": F.coalesce(grade, F.lit(-1)),
    })
    signature = ["_subject", "_grade", "_terms"]
    distinct = asked.select(*signature).distinct()

    # Unknown values count as no filter, and so does a pair nothing answers to.
    told = distinct.withColumns({"subject": F.col("_subject"), "grade": F.col("_grade")})
    known = scoped.select("subject", "grade").distinct()
    if has_subject:
        names = known.where("grade = -1").select("subject", F.lit(True).alias("_s"))
        told = told.join(names, "subject", "left").withColumn("subject", F.when(F.col("_s"), F.col("subject")).otherwise(""))
    if has_grade:
        grades = known.where("subject = ''").select("grade", F.lit(True).alias("_g"))
        told = told.join(grades, "grade", "left").withColumn("grade", F.when(F.col("_g"), F.col("grade")).otherwise(-1))
    if has_subject and has_grade:
        told = told.join(known.withColumn("_k", F.lit(True)), ["subject", "grade"], "left").withColumns({
            "subject": F.when(F.col("_k"), F.col("subject")).otherwise(""), "grade": F.when(F.col("_k"), F.col("grade")).otherwise(-1),
        })
    lookups = told.select(*signature, "subject", "grade", F.explode(_subsets(F.col("_terms"))).alias("subset")).withColumn(
        "matches", F.size(F.split("subset", " "))
    )
    hits = lookups.join(subset_index(scoped, lookups.select("subset")), ["subject", "grade", "subset"])
    best = hits.groupBy(*signature).agg(
        F.max("matches").alias("matches"),
        F.min_by("id", F.struct((-F.col("matches")).alias("m"), F.col("id"))).alias("id"),
    )
    scored = best.withColumn("confidence", cat.overlap_score(F.col("matches"), F.size("_terms"))).where(F.col("confidence") >= floor)
    return asked.join(scored, signature).drop(*signature)
