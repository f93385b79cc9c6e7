"""Small string helpers with Unicode-aware whitespace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once.

    An expression named inside a lambda is evaluated for every element the
    lambda sees; bound as the element of a one-element array it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text.

    ``split`` compiles its pattern for every row unless it is one plain
    character; ``regexp_replace`` compiles a literal one once per task.
    """
    return F.filter(F.split(F.regexp_replace(c, SPACE, " "), " "), lambda w: w != "")


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when any literal occurs in ``c``."""
    found = F.lit(False)
    for needle in needles:
        found = found | c.contains(needle)
    return found


def matches_any(c: Column, patterns: list[str], flags: str = "") -> Column:
    """True when any regular expression is found in ``c``."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | c.rlike(flags + pattern)
    return found


def truncate_at_word(c: Column, limit: int) -> Column:
    """Cut at a word end and add ``...`` when the text is longer than ``limit``."""
    kept = F.aggregate(
        words(c),
        F.struct(F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda acc, w: F.when(
            acc["open"] & (F.length(acc["text"]) + F.length(w) + 1 <= limit - 3),
            F.struct(F.concat(acc["text"], F.lit(" "), w).alias("text"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["text"].alias("text"), F.lit(False).alias("open"))),
        lambda acc: F.concat(F.trim(acc["text"]), F.when(acc["open"], F.lit("")).otherwise(F.lit("..."))),
    )
    return F.when(F.length(c) <= limit, c).otherwise(kept)


GRAM = 3


def letters(text: Column) -> Column:
    return F.split(text, "")


def grams(spelt: Column, n: int) -> Column:
    """The distinct runs of ``n`` of an array of letters."""
    last = F.size(spelt) - n
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*[spelt[i + k] for k in range(n)]))
    return F.when(last >= 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
