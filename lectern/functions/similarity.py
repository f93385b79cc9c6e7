"""String similarity ratio (F35) and the windowed phrase removal built on it."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.words import words


def ratio_above(a: str, b: str, floor: float, inclusive: bool = False) -> float | None:
    """The ratio when it passes ``floor``, else None; cheap upper bounds first."""
    matcher = SequenceMatcher(None, a, b)
    for bound in (matcher.real_quick_ratio, matcher.quick_ratio, matcher.ratio):
        value = bound()
        if value < floor or (value == floor and not inclusive):
            return None
    return value


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of each pair; null when either side is null."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)],
            dtype="float64",
        )

    return ratio(a, b)


def length_can_reach(a: Column, b: Column, floor: float) -> Column:
    """Native bound: a ratio over ``floor`` needs 2*min(len)/(sum of len) over it too."""
    la, lb = F.length(a), F.length(b)
    return 2.0 * F.least(la, lb) >= floor * (la + lb)


def rows_with_likely_window(rows: list[list[str]], phrases: list[str], floor: float) -> set[int]:
    """Numbers of the rows (lists of lower-case words) in which a window may resemble a phrase.

    The ratio never exceeds 2 x (characters in common) / (sum of lengths), and
    characters in common follow from running counts per letter. So a few array
    operations over a whole batch rule out almost every window.
    """
    words = [w for row in rows for w in row]
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    if not words:
        return set()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    codes = np.frombuffer(" ".join(words).encode("utf-32-le"), dtype="<u4")
    letters = sorted(set("".join(phrases)))
    # Counts before each word start and at each word end, one letter at a time.
    at_start, at_end = (np.empty((len(letters), len(words)), dtype="int32") for _ in range(2))
    for n, letter in enumerate(letters):
        seen = np.r_[0, np.cumsum(codes == ord(letter), dtype="int32")]
        at_start[n], at_end[n] = seen[starts], seen[ends]
    likely: set[int] = set()
    for phrase in phrases:
        span = len(phrase.split())
        n = len(words) - span + 1
        if n <= 0:
            continue
        wanted = np.array([[phrase.count(ch)] for ch in letters], dtype="int32")
        common = np.minimum(at_end[:, span - 1 :] - at_start[:, :n], wanted).sum(axis=0)
        size = ends[span - 1 :] - starts[:n] + len(phrase)
        hit = (2 * common + 1e-9 >= floor * size) & (owner[:n] == owner[span - 1 :])
        likely.update(owner[:n][hit].tolist())
    return likely


def best_window(tokens: list[str], phrase: str, floor: float) -> int:
    """Start of the first best window of ``tokens`` that resembles ``phrase``, or -1."""
    span = len(phrase.split())
    lowered = [t.lower() for t in tokens]
    best, where = 0.0, -1
    for i in range(len(tokens) - span + 1):
        value = ratio_above(" ".join(lowered[i : i + span]), phrase, floor, inclusive=True)
        if value is not None and value > best:
            best, where = value, i
    return where


def fuzzy_removal(phrases: list[str], floor: float):
    """An Arrow function: question to (text, number of phrases removed)."""

    lowered = [p.lower() for p in phrases]

    def clean(question: str) -> tuple[str, int]:
        n = 0
        for phrase in lowered:
            tokens = question.split()
            at = best_window(tokens, phrase, floor)
            if at >= 0:
                question = " ".join(tokens[:at] + tokens[at + len(phrase.split()) :])
                n += 1
        return question, n

    @F.pandas_udf("text string, hits int")
    def remove(questions: pd.Series) -> pd.DataFrame:
        texts = questions.tolist()
        rows = [[] if not isinstance(q, str) else q.lower().split() for q in texts]
        likely = rows_with_likely_window(rows, lowered, floor)
        # A row without a likely window cannot lose a phrase: its text stays as it is.
        done = [clean(q) if i in likely else (q, 0) for i, q in enumerate(texts)]
        return pd.DataFrame({"text": [t for t, _ in done], "hits": [n for _, n in done]})

    return remove


def may_hold_phrase(question: Column, phrases: list[str], floor: float) -> Column:
    """Native test that keeps rows without a chance away from Python.

    A window at ratio r over a phrase of p characters shares at least r*p/(2-r)
    of its characters, so that many distinct letters of the phrase must occur in
    the question, less the copies of repeated letters.
    """
    lowered = F.lower(question)
    possible = F.lit(False)
    for phrase in phrases:
        text = phrase.lower()
        need = floor * len(text) / (2 - floor)
        letters = sorted(set(text))
        have = sum((F.when(lowered.contains(ch), text.count(ch)).otherwise(0) for ch in letters), F.lit(0))
        possible = possible | ((have >= need) & (F.size(words(lowered)) >= len(text.split())))
    return possible
