"""Question tables: learned phrases, spelling corrections, normalisation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import gates, normalise
from lectern.functions.words import GRAM, grams, letters, strip
from lectern.operators.layout import written


def learned_dictionary(*phrase_tables: DataFrame) -> DataFrame:
    """The union of approved phrases, lower-cased, trimmed, distinct, not blank."""
    joined = phrase_tables[0].select("phrase")
    for other in phrase_tables[1:]:
        joined = joined.unionByName(other.select("phrase"))
    return joined.select(strip(F.lower("phrase")).alias("phrase")).where("phrase <> ''").distinct()


def phrase_hits(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(key, phrase) for every phrase of the dictionary that a lower-case text holds. ``texts``: key, text.

    A phrase is filed under one run of letters, the one that fewest texts have; only texts that hold
    it meet the phrase. Phrases of one or two letters are filed under themselves.
    """
    spelt = texts.select("key", letters(F.col("text")).alias("letters"))
    phrases = dictionary.select("phrase", letters(F.col("phrase")).alias("letters"))
    held = F.concat(*[grams(F.col("letters"), n) for n in range(1, GRAM + 1)])
    # Only runs that some phrase could be filed under leave the texts.
    own = F.when(F.size("letters") >= GRAM, grams(F.col("letters"), GRAM)).otherwise(F.array("phrase"))
    filed = written(phrases.select("phrase", F.explode(own).alias("gram")), "phrase-grams")
    wanted = written(filed.select("gram").distinct(), "grams")
    met = written(spelt.select("key", F.explode(held).alias("gram")).join(wanted, "gram", "left_semi"), "text-grams")
    counted = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A phrase with a run that no text has occurs nowhere.
    rated = filed.join(counted, "gram", "left")
    best = rated.groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b")).where("b.n > 0")
    maybe = met.join(best.select("phrase", F.col("b.gram").alias("gram")), "gram").select("key", "phrase")
    return maybe.join(texts.select("key", "text"), "key").where(F.contains("text", F.col("phrase"))).select("key", "phrase")


def attach_learned(questions: DataFrame, dictionary: DataFrame, name: str = "learned", text: str = "question") -> DataFrame:
    """Put beside each question the phrases that its removal has to try, longest first.

    ``normalise.remove_learned`` takes phrases away one after another, and what closes up may spell another
    one. So the phrases found are taken away, every text on the way is looked up in turn, and that goes on until no
    text shows a phrase not known for its question: the fold over those phrases is then the fold over all.
    The dictionary may have any size; a row carries no more phrases than occur in its texts.
    """
    key = F.md5(F.col(text))
    asked = written(questions.where(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("text")).distinct(), "asked")
    dictionary = written(dictionary.select("phrase").where("phrase <> ''").distinct(), "dictionary")
    lookup = asked.select("key", F.lower("text").alias("text"))
    found = None
    while True:
        # Texts on the way are many per question; each different one is looked up once.
        lookup = written(lookup.select("key", F.md5("text").alias("of"), "text").distinct(), "lookup")
        once = lookup.select(F.col("of").alias("key"), "text").distinct()
        hits = lookup.select("key", "of").join(phrase_hits(once, dictionary).withColumnRenamed("key", "of"), "of").select("key", "phrase").distinct()
        fresh = hits if found is None else hits.join(found, ["key", "phrase"], "left_anti")
        fresh = written(fresh, "fresh")
        if not fresh.limit(1).count():
            break
        found = written(fresh if found is None else found.unionByName(fresh), "found")
        changed = found.join(fresh.select("key").distinct(), "key", "left_semi")
        steps = asked.join(_longest_first(changed), "key").select("key", normalise.removal_steps(F.col("text"), F.col("phrases")).alias("steps"))
        lookup = steps.select("key", F.explode("steps").alias("text")).select("key", F.lower("text").alias("text"))
    if found is None:
        return questions.withColumn(name, F.array().cast("array<string>"))
    listed = written(_longest_first(found), "listed").select(F.col("key").alias("_key"), F.col("phrases").alias("_hits"))
    out = questions.withColumn("_key", key).join(listed, "_key", "left")
    return out.withColumn(name, F.coalesce("_hits", F.array().cast("array<string>"))).drop("_key", "_hits")


def _longest_first(found: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_set(F.struct((-F.length("phrase")).alias("n"), F.col("phrase").alias("p"))))
    return found.groupBy("key").agg(F.transform(ordered, lambda s: s["p"]).alias("phrases"))


def learned_from(dictionary: DataFrame):
    """The dictionary in the form that ``normalise.normalise_questions`` takes: looked up where the chain has come to."""
    return partial(_attach_for, dictionary)


def _attach_for(dictionary: DataFrame, df: DataFrame, text: str, name: str) -> DataFrame:
    return attach_learned(df, dictionary, name, text)


def correct_spelling(questions: DataFrame, corrections: DataFrame, text: str = "question") -> DataFrame:
    """Replace a question by its stored correction.

    ``corrections``: key, corrected. Adds ``corrected`` and ``spell_hit``. The
    join side follows the table's measured size; AQE splits a hot question.
    """
    keyed = questions.withColumn("_key", normalise.spell_key(F.col(text)))
    table = corrections.groupBy(F.col("key").alias("_key")).agg(F.max("corrected").alias("_fix"))
    return (
        keyed.join(table, "_key", "left")
        .withColumns({"corrected": F.coalesce("_fix", text), "spell_hit": F.col("_fix").isNotNull()})
        .drop("_key", "_fix")
    )


def spell_cache_counts(corrected: DataFrame, text: str = "question") -> DataFrame:
    """Hits, and misses among the questions the spelling gate lets through."""
    hit = F.col("spell_hit")
    return corrected.agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit & gates.needs_spell_check(F.col(text))).alias("misses")
    )


def feedback_log(questions: DataFrame, text: str = "question") -> DataFrame:
    """The normaliser's log row for every question (D10 without the clock)."""
    done = normalise.normalise_questions(questions, text)
    return done.withColumnsRenamed({text: "original", "clean_question": "clean"})
