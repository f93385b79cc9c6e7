"""Row predicates and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions.normalise import is_all_caps
from lectern.functions.words import contains_any, matches_any, strip, words


def canned_reply(q: Column, name: str = lexicon.ASSISTANT_NAME) -> Column:
    """A fixed reply for blank, short, greeting, thanks and apology turns, else null."""
    said = F.lower(strip(q))
    return (
        F.when(F.coalesce(said, F.lit("")) == "", lexicon.REPLY_BLANK)
        .when(F.length(said) < 4, lexicon.REPLY_SHORT)
        .when(said.isin(lexicon.GREETINGS), lexicon.REPLY_GREETING.format(name=name))
        .when(said.isin(lexicon.GRATITUDE), lexicon.REPLY_GRATITUDE)
        .when(said.isin(lexicon.APOLOGIES), lexicon.REPLY_APOLOGY)
    )


def is_math_query(q: Column) -> Column:
    """P4"""
    return contains_any(F.lower(q), lexicon.MATH_MARKS)


def should_retrieve(q: Column) -> Column:
    """P5: whether a question gains from retrieved context."""
    said = strip(F.lower(q))
    n = F.size(words(q))
    return (
        F.when(F.coalesce(F.length(strip(q)), F.lit(0)) < 5, False)
        .when(contains_any(said, lexicon.CHITCHAT), False)
        .when((n < 4) & ~contains_any(said, lexicon.CURRICULUM_TERMS), False)
        .when(contains_any(said, lexicon.CURRICULUM_INDICATORS), True)
        .otherwise(n > 10)
    )


def needs_spell_check(q: Column) -> Column:
    """P8"""
    n = F.size(words(q))
    typo = matches_any(q, [r"\b\w*[0-9]+\w*\b", r"\b\w{15,}\b", r"(.)\1{3,}"], "(?U)")
    return (
        F.when(n < 5, False)
        .when(q.rlike(r"^[A-D]\)") | q.rlike(r"(?U)^\d+\."), False)
        .when(is_all_caps(q), False)
        .when(typo, True)
        .otherwise(n > 10)
    )


def may_match_catalogue(q: Column) -> Column:
    """Not a calculation, and names something that can be drawn."""
    said = F.lower(q)
    return ~matches_any(said, lexicon.MATH_PATTERNS, "(?U)") & matches_any(said, lexicon.VISUAL_PATTERNS, "(?U)")


def show_match(question: Column, answer: Column, confidence: Column) -> Column:
    """P10"""
    said = F.lower(question)
    return (
        (confidence >= lexicon.MATCH_FLOOR)
        & contains_any(said, lexicon.SHOW_TRIGGERS)
        & (F.size(words(answer)) > 25)
        & ~contains_any(said, lexicon.FACTUAL_MARKS)
    )


def low_confidence(confidence: Column, floor: float = 0.7) -> Column:
    """A missing confidence counts as certain."""
    return F.coalesce(confidence, F.lit(1.0)) < floor


def valid_username(name: Column) -> Column:
    """P12"""
    return F.coalesce(name.rlike(lexicon.USERNAME_PATTERN), F.lit(False))


def payload_fits(payload: Column, limit: int = lexicon.PAYLOAD_LIMIT) -> Column:
    """P13 on text; pass ``to_json(struct)`` for nested values."""
    return F.coalesce(F.length(payload) < limit, F.lit(False))


def is_noise_phrase(phrase: Column) -> Column:
    """P16"""
    lowered = F.lower(phrase)
    return contains_any(lowered, lexicon.NOISE_INDICATORS) | matches_any(lowered, lexicon.NOISE_PATTERNS)


def confidence_band(confidence: Column) -> Column:
    """Display band."""
    return F.when(confidence > 0.7, "high").when(confidence > 0.4, "medium").otherwise("low")


def show_sources(confidence: Column) -> Column:
    return confidence < 0.6


def offer_fallback(confidence: Column) -> Column:
    return confidence < 0.4
