"""Recurring noise phrases in question logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import gates
from lectern.functions.words import contains_any, let, words
from lectern.operators.layout import written

TOP_PHRASES = 100


def ngrams(tokens: Column, shortest: int = 2, longest: int = 4, min_chars: int = 6) -> Column:
    """All n-grams of an array of words as joined text, short ones dropped."""

    def of_length(n: int) -> Column:
        last = F.size(tokens) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    every = F.concat(*[of_length(n) for n in range(shortest, longest + 1)])
    return F.filter(every, lambda g: F.length(g) >= min_chars)


def low_confidence_logs(logs: DataFrame, floor: float = 0.7) -> DataFrame:
    """P11"""
    return logs.where(gates.low_confidence(F.col("confidence"), floor))


def ngram_counts(logs: DataFrame) -> DataFrame:
    """N-gram frequencies. Counts are summed before the shuffle; no raw text is moved."""
    tokens = logs.select(words(F.lower("original")).alias("w"))
    return tokens.select(F.explode(ngrams(F.col("w"))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("frequency"))


def top_ngrams(counts: DataFrame, n: int = TOP_PHRASES) -> DataFrame:
    """T4: the most common, ties by phrase."""
    return counts.orderBy(F.desc("frequency"), "phrase").limit(n)


def _occurrences(logs: DataFrame, phrases: DataFrame, *cols: str) -> DataFrame:
    """One row per log row and phrase it contains.

    There are at most 100 phrases, so they travel as one array and are tested in
    place; no join is needed.
    """
    listed = phrases.agg(F.array_sort(F.collect_set("phrase"))).scalar()
    held = let(F.lower("original"), lambda text: F.filter("_all", lambda p: F.contains(text, p)))
    return logs.withColumn("_all", listed).select(
        *cols, F.lower("original").alias("_text"), F.explode(held).alias("phrase")
    )


def phrase_confidence(frequency: Column, starts: Column, phrase: Column) -> Column:
    """A9"""
    score = (
        F.lit(0.5)
        + F.when(frequency > 50, 0.2).when(frequency > 20, 0.1).otherwise(0.0)
        + F.when(starts > frequency * 0.7, 0.15).otherwise(0.0)
        + F.when(contains_any(F.lower(phrase), lexicon.NOISE_INDICATORS), 0.15).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), score), 2)


def mine_phrases(logs: DataFrame, min_frequency: int = 10, min_confidence: float = 0.6) -> DataFrame:
    """Suggested noise phrases with frequency and confidence.

    The 100 most common n-grams are taken before the other conditions apply.
    """
    low = low_confidence_logs(logs)
    # Used twice below: written, so the n-grams are counted once and the joins see its size.
    top = written(top_ngrams(ngram_counts(low)), "phrases").where(
        (F.col("frequency") >= min_frequency) & gates.is_noise_phrase(F.col("phrase"))
    )
    starting = (
        _occurrences(low.select("original"), top).groupBy("phrase")
        .agg(F.count_if(F.startswith(F.col("_text"), F.col("phrase"))).alias("starts"))
    )
    return (
        top.join(starting, "phrase", "left")
        .withColumn(
            "confidence",
            phrase_confidence(F.col("frequency"), F.coalesce("starts", F.lit(0)), F.col("phrase")),
        )
        .where(F.col("confidence") >= min_confidence)
        .select("phrase", "frequency", "confidence")
    )


def phrase_examples(logs: DataFrame, suggestions: DataFrame, seq: list[str], k: int = 3) -> DataFrame:
    """The first ``k`` low-confidence questions holding each phrase, in log order."""
    order = Window.partitionBy("phrase").orderBy(*seq)
    return (
        _occurrences(low_confidence_logs(logs), suggestions, "original", *seq)
        .withColumn("example", F.row_number().over(order)).where(F.col("example") <= k)
        .select("phrase", "example", "original")
    )


def report_lines(suggestions: DataFrame, examples: DataFrame) -> DataFrame:
    """K9: one block of markdown per suggestion, ranked by confidence x frequency."""
    quoted = examples.groupBy("phrase").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("example", "original"))),
                lambda e: F.format_string('  - "%s"', e["original"]),
            ),
            "\n",
        ).alias("_ex")
    )
    # At most 100 suggestions leave the top-n, so one window over them is small.
    order = Window.orderBy(F.desc(F.col("confidence") * F.col("frequency")), "phrase")
    return (
        suggestions.withColumn("rank", F.row_number().over(order)).join(quoted, "phrase", "left")
        .select(
            "rank", "phrase",
            F.format_string(
                '## %d. "%s"\n\n- **Frequency**: %d\n- **Confidence**: %.2f\n- **Examples**:\n%s',
                "rank", "phrase", "frequency", "confidence", F.coalesce("_ex", F.lit("")),
            ).alias("block"),
        )
    )
