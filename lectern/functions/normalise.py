"""Question normaliser as composed Column expressions.

Each step takes and returns a text Column. ``normalise_questions`` applies the
chain to a DataFrame one projection at a time, so every intermediate text is
computed once and stays inside generated code, except the fuzzy step, which
visits only the rows that can hold a phrase.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import similarity
from lectern.functions.words import SPACE, collapse, matches_any, strip, words

ANY_CASE = "(?iuU)"


def strip_starters(q: Column, starters=lexicon.STARTERS) -> Column:
    """one leading conversational word of each kind, in order."""
    return reduce(lambda c, w: F.regexp_replace(c, rf"{ANY_CASE}^{w}\s+", ""), starters, q)


def expand_slang(q: Column, slang=lexicon.SLANG) -> Column:
    """F2"""
    return reduce(lambda c, kv: F.regexp_replace(c, rf"{ANY_CASE}\b{kv[0]}\b", kv[1]), slang, q)


def drop_fillers(q: Column, fillers=lexicon.FILLERS) -> Column:
    """F3"""
    return reduce(lambda c, w: F.regexp_replace(c, rf"{ANY_CASE}\b{w}\b", ""), fillers, q)


def strip_politeness(q: Column, patterns=lexicon.POLITENESS) -> Column:
    """F4"""
    return reduce(lambda c, p: F.regexp_replace(c, ANY_CASE + p, ""), patterns, q)


def formalise(q: Column) -> Column:
    """F1-F4 followed by whitespace collapse."""
    return collapse(strip_politeness(drop_fillers(expand_slang(strip_starters(q)))))


def tidy(q: Column) -> Column:
    """collapse whitespace, then drop leading punctuation."""
    return F.regexp_replace(collapse(q), r"(?U)^[,:;\-\s]+", "")


def repair_case(q: Column) -> Column:
    """capitals, first letter, question mark."""
    rest = F.substring(q, 2, 1 << 30)
    first_up = F.concat(F.upper(F.substring(q, 1, 1)), F.when(is_all_caps(q), F.lower(rest)).otherwise(rest))
    asks = reduce(lambda a, w: a | F.lower(first_up).startswith(w), lexicon.QUESTION_WORDS, F.lit(False))
    marked = F.when(
        asks & ~first_up.endswith("?"), F.concat(F.regexp_replace(first_up, r"[.!,;:]+$", ""), F.lit("?"))
    ).otherwise(first_up)
    return F.regexp_replace(marked, r"\?+", "?")


def is_all_caps(q: Column) -> Column:
    return (F.upper(q) == q) & (F.lower(q) != q)


def context_of(q: Column, rules=lexicon.CONTEXT_RULES) -> Column:
    """the context phrase to insert, or null."""
    lowered = F.lower(q)
    found = F.lit(None).cast("string")
    for phrase, required in reversed(rules):
        hit = reduce(lambda a, w: a | lowered.contains(w), required, F.lit(False)) & ~lowered.contains(phrase)
        found = F.when(hit, F.lit(phrase)).otherwise(found)
    vague = (F.size(words(q)) <= lexicon.CONTEXT_MAX_WORDS) & q.rlike(ANY_CASE + r"what happens\s+(when|if)")
    return F.when(vague, found)


def insert_context(q: Column, context: Column) -> Column:
    pattern = ANY_CASE + r"(?s)^(.*?what happens)(\s+(?:when|if))"
    return F.when(
        context.isNotNull(),
        F.regexp_replace(q, F.lit(pattern), F.concat(F.lit("$1 in a "), context, F.lit("$2"))),
    ).otherwise(q)


def intent_of(q: Column, intents=lexicon.INTENTS) -> Column:
    """the first intent one of whose patterns is found."""
    lowered = F.lower(q)
    chosen = F.lit(lexicon.DEFAULT_INTENT)
    for name, patterns in reversed(intents):
        chosen = F.when(matches_any(lowered, patterns), F.lit(name)).otherwise(chosen)
    return chosen


def confidence_of(raw: Column, clean: Column, notes: Column) -> Column:
    """F12, rounded to two places."""
    shrink = F.when(F.length(clean) / F.greatest(F.length(raw), F.lit(1)) < 0.5, 0.2).otherwise(0.0)
    noisy = F.when(F.size(notes) > 5, 0.15).when(F.size(notes) > 3, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.lit(1.0) - shrink - noisy)), 2)


def scaffold(clean: Column, intent: Column) -> Column:
    """F14"""
    prompts = F.create_map(*[F.lit(x) for kv in lexicon.SCAFFOLDS.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(prompts, intent), F.lit(lexicon.DEFAULT_SCAFFOLD)), F.lit(" "), clean)


def remove_learned(q: Column, phrases: Column) -> Column:
    """J7 for one row: a struct of the text left and the number of phrases removed.

    ``phrases`` is an array of lower-case phrases, longest first.
    """
    return F.aggregate(
        F.coalesce(phrases, F.array().cast("array<string>")),
        F.struct(q.alias("text"), F.lit(0).alias("hits")),
        lambda acc, p: F.when(
            F.contains(F.lower(acc["text"]), p),
            F.struct(
                F.regexp_replace(acc["text"], F.concat(F.lit(r"(?iu)\Q"), p, F.lit(r"\E")), F.lit("")).alias("text"),
                (acc["hits"] + 1).alias("hits"),
            ),
        ).otherwise(acc),
    )


def removal_steps(q: Column, phrases: Column) -> Column:
    """The texts that ``remove_learned`` passes through, after each phrase that it finds."""
    start = F.struct(q.alias("text"), F.array().cast("array<string>").alias("steps"))

    def step(acc: Column, p: Column) -> Column:
        left = F.regexp_replace(acc["text"], F.concat(F.lit(r"(?iu)\Q"), p, F.lit(r"\E")), F.lit(""))
        taken = F.struct(left.alias("text"), F.array_append(acc["steps"], left).alias("steps"))
        return F.when(F.contains(F.lower(acc["text"]), p), taken).otherwise(acc)

    return F.aggregate(phrases, start, step)["steps"]


def normalise_questions(
    df: DataFrame,
    text: str = "question",
    learned: str | Callable[[DataFrame, str, str], DataFrame] | None = None,
    scaffolding: bool = False,
) -> DataFrame:
    """adds clean_question, intent, confidence and notes to every row.

    ``learned`` names an array column of the phrases that may occur in the row, or is a
    function of (rows, text column, new column) that adds one once the steps before have been taken;
    ``operators.questions.learned_from`` makes it from a phrase table of any size.
    """
    raw = F.col(text)
    valid = F.coalesce(F.length(raw) >= 3, F.lit(False))
    out = df.withColumn("_raw", F.when(valid, strip(raw)))
    out = out.withColumn("_formal", formalise(F.col("_raw")))
    out = out.withColumn("_n1", F.array(F.when(F.col("_formal") != F.col("_raw"), F.lit("formalized"))))
    # each pattern sees the text the one before it left.
    out = out.withColumn("_q", F.col("_formal")).withColumn("_n2", F.array().cast("array<string>"))
    for pattern in lexicon.EXAM_NOISE:
        hit = F.when(F.col("_q").rlike(ANY_CASE + pattern), F.lit("removed_regex"))
        out = out.withColumns(
            {"_n2": F.array_append("_n2", hit), "_q": F.regexp_replace("_q", ANY_CASE + pattern, "")}
        )
    phrases, floor = lexicon.FUZZY_PHRASES, lexicon.FUZZY_THRESHOLD
    maybe = similarity.may_hold_phrase(F.col("_q"), phrases, floor)
    out = out.withColumn("_f", similarity.fuzzy_removal(phrases, floor)(F.when(maybe, F.col("_q"))))
    out = out.withColumns(
        {
            "_n2": F.concat("_n2", F.array_repeat(F.lit("removed_fuzzy"), F.coalesce(F.col("_f.hits"), F.lit(0)))),
            "_q": F.coalesce("_f.text", "_q"),
        }
    )
    if callable(learned):
        out, learned = learned(out, "_q", "_phrases"), "_phrases"
    if learned:
        out = out.withColumn("_l", remove_learned(F.col("_q"), F.col(learned)))
        out = out.withColumns(
            {
                "_n2": F.concat("_n2", F.array_repeat(F.lit("removed_learned"), F.coalesce(F.col("_l.hits"), F.lit(0)))),
                "_q": F.col("_l.text"),
            }
        )
    out = out.withColumn("_q", tidy(F.col("_q"))).withColumn("_n3", F.array().cast("array<string>"))
    for short, full in lexicon.ABBREVIATIONS:  # F8
        pattern = rf"(?U)\b{short}\b"
        out = out.withColumns(
            {
                "_n3": F.array_append("_n3", F.when(F.col("_q").rlike(pattern), F.lit("expanded_abbrev"))),
                "_q": F.regexp_replace("_q", pattern, full),
            }
        )
    out = out.withColumn("_caps", F.when(is_all_caps(F.col("_q")), F.lit("fixed_caps")))
    out = out.withColumn("_q", repair_case(F.col("_q")))
    out = out.withColumn("_ctx", context_of(F.col("_q")))
    out = out.withColumn("_q", insert_context(F.col("_q"), F.col("_ctx")))
    notes = F.array_compact(
        F.concat(
            "_n1", "_n2", "_n3",
            F.array("_caps", F.when(F.col("_ctx").isNotNull(), F.lit("expanded_context"))),
        )
    )
    out = out.withColumn("notes", F.when(valid, notes).otherwise(F.array(F.lit("fallback: Invalid input"))))
    out = out.withColumn("clean_question", F.when(valid, F.col("_q")).otherwise(F.coalesce(raw, F.lit(""))))
    out = out.withColumns(
        {
            "intent": F.when(valid, intent_of(F.col("clean_question"))).otherwise(F.lit("UNKNOWN")),
            "confidence": F.when(valid, confidence_of(raw, F.col("clean_question"), F.col("notes"))).otherwise(0.0),
        }
    )
    if scaffolding:
        out = out.withColumn(
            "scaffolded_prompt", F.when(valid, scaffold(F.col("clean_question"), F.col("intent")))
        )
    return out.drop("_raw", "_formal", "_q", "_n1", "_n2", "_n3", "_f", "_l", "_phrases", "_caps", "_ctx")


def spell_key(q: Column) -> Column:
    """F16: key of the spelling table."""
    return F.md5(strip(F.lower(q)))


def answer_key(q: Column, subject: Column, grade: Column) -> Column:
    """F16: key of the answer cache."""
    return F.md5(F.concat_ws("|", strip(F.lower(q)), F.lower(subject), grade))
