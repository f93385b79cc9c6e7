"""Answer checks, confidence, cleaning, prompts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions.words import contains_any, let, strip, words


def grounding(answer: Column, context: Column, floor: float = lexicon.GROUNDING_FLOOR) -> Column:
    """struct(grounded, reason). ``context`` is an array of texts."""
    said = F.lower(answer)
    terms = F.array_distinct(F.regexp_extract_all(said, F.lit(r"(?U)\b(\w{5,})\b"), F.lit(1)))
    held = let(
        F.lower(F.array_join(context, " ")),
        lambda told: F.transform(terms, lambda t: F.contains(told, t)),
    )

    def verdict(ok: bool, reason: Column | str) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(ok).alias("grounded"), why.alias("reason"))

    def judge(found: Column) -> Column:
        share = F.size(F.filter(found, lambda f: f)) / F.size(found)
        low = F.format_string("Low context overlap (%.0f%%)", F.bround(share * 100, 0))
        return (
            F.when(F.size(found) == 0, verdict(True, "No key terms to validate"))
            .when(share < floor, verdict(False, low))
            .when(contains_any(said, lexicon.FORBIDDEN_PHRASES), verdict(False, "Model admitted lack of knowledge"))
            .otherwise(verdict(True, "Grounded"))
        )

    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(F.size(context), F.lit(0)) == 0)
    return (
        F.when(empty, verdict(False, "No answer or context"))
        .when(F.size(words(answer)) < 5, verdict(True, "Answer too short to validate"))
        .otherwise(let(held, judge))
    )


def context_relevant(question: Column, context: Column) -> Column:
    """Two words over three letters, or one over five, occur in the context."""
    asked = F.array_distinct(F.filter(words(F.lower(question)), lambda w: F.length(w) > 3))
    found = let(F.lower(context), lambda told: F.filter(asked, lambda w: F.contains(told, w)))
    enough = let(found, lambda ws: (F.size(ws) >= 2) | F.exists(ws, lambda w: F.length(w) > 5))
    return F.when(F.coalesce(F.length(strip(context)), F.lit(0)) < 20, False).otherwise(enough)


def _word_overlap(answer: Column, question: Column) -> tuple[Column, Column]:
    asked = F.array_distinct(F.filter(words(question), lambda w: F.length(w) > 3))
    asked = F.array_distinct(F.transform(asked, lambda w: F.lower(w)))
    told = F.array_distinct(F.transform(words(answer), lambda w: F.lower(w)))
    return F.size(F.array_intersect(asked, told)), F.size(asked)


def answer_confidence(answer: Column, question: Column, mean_score: Column | None = None) -> Column:
    """F29 + A10: from length, overlap with the question and the mean context score.

    ``mean_score`` is null when no context was used.
    """
    n = F.size(words(answer))
    common, asked = _word_overlap(answer, question)
    length = F.when(n.between(50, 150), 0.2).when(n.between(30, 49) | n.between(151, 200), 0.1).otherwise(0.0)
    overlap = F.when(asked > 0, common / asked * 0.2).otherwise(0.0)
    context = F.coalesce(mean_score * 0.1, F.lit(0.0)) if mean_score is not None else F.lit(0.0)
    return F.when(F.coalesce(n, F.lit(0)) < 5, 0.3).otherwise(F.least(F.lit(1.0), F.lit(0.5) + length + overlap + context))


def model_confidence(answer: Column, question: Column) -> Column:
    """F30"""
    common, asked = _word_overlap(answer, question)
    n = F.coalesce(F.size(words(answer)), F.lit(0))
    return F.when(n < 5, 0.3).otherwise(F.least(F.lit(1.0), F.lit(0.5) + common / F.greatest(F.lit(1), asked) * 0.5))


def clean_answer(answer: Column, markers=lexicon.CUT_MARKERS) -> Column:
    """no Q:/A: labels, nothing after a marker, single spaces, a final stop."""
    text = strip(answer)
    text = F.regexp_replace(text, r"(?iU)^(Q:|A:)\s*", "")
    text = F.regexp_replace(text, r"(?iU)\n(Q:|A:)\s*", "\n")
    for marker in markers:
        text = F.when(text.contains(marker), strip(F.substring_index(text, marker, 1))).otherwise(text)
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    done = F.when((text != "") & ~text.rlike(r"[.!?]$"), F.concat(text, F.lit("."))).otherwise(text)
    return F.coalesce(done, F.lit(""))


def build_prompt(question: Column, context: Column, limit: int = 850, name: str = lexicon.ASSISTANT_NAME) -> Column:
    """F32: instruction, context cut back to its last full stop, question."""
    head = F.lit(lexicon.ANSWER_INSTRUCTION.format(name=name))
    told = strip(F.coalesce(context, F.lit("")))
    short = F.substring(told, 1, limit)
    cut = F.when(
        F.length(told) > limit, F.concat(F.regexp_replace(short, r"(?s)\.[^.]*$", ""), F.lit("."))
    ).otherwise(told)
    return F.when(
        told != "", F.concat(head, F.lit("\nReference material:\n"), cut, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
    ).otherwise(F.concat(head, F.lit("\nQuestion: "), question, F.lit("\nAnswer:")))


def parse_verdict(reply: Column, answer: Column, key: Column) -> Column:
    """struct(correct, explanation) from a grading reply.

    Without a verdict in the reply the answer is compared with the key.
    """
    upper = F.upper(reply)
    yes, no = upper.contains("[CORRECT]"), upper.contains("[INCORRECT]")
    bare = lambda c: strip(F.regexp_replace(c, r"^\[.*?\]", ""))
    text = bare(reply)
    text = F.when(F.upper(text).startswith("VERDICT:"), bare(strip(F.substring(text, 9, 1 << 30)))).otherwise(text)
    text = F.when(F.upper(text).startswith("FEEDBACK:"), strip(F.substring(text, 10, 1 << 30))).otherwise(text)
    same = F.coalesce((F.lower(answer) == F.lower(key)) & (key != ""), F.lit(False))
    return F.struct(F.when(~yes & ~no, same).otherwise(yes).alias("correct"), text.alias("explanation"))


def joined_context(texts: Column, chunks: int = 2, limit: int = 600) -> Column:
    """T9"""
    return F.substring(F.array_join(F.slice(texts, 1, chunks), "\n\n"), 1, limit)
