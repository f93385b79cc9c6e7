"""Overlapping chunks that keep formulas and code whole.

Where a cut falls depends on the cut before it, so one text is cut by one small
Python function. Spark spreads the documents; the result is an array column that
explodes into chunk rows, so other columns never leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.words import strip

# What counts as a formula, as code, and as the end of a sentence.
FORMULAS = [
    re.compile(r"\$\$.*?\$\$", re.DOTALL),
    re.compile(r"\$[^\$]+?\$"),
    re.compile(r"\\\[.*?\\\]", re.DOTALL),
    re.compile(r"\\\(.*?\\\)"),
]
RAISED = "²³⁴⁵⁶⁷⁸⁹⁰₁₂₃₄₅₆₇₈₉₀^"
SUPERSCRIPT = re.compile(rf"[a-zA-Z]\s*[{re.escape(RAISED)}]\s*[+\-=]")
CLAUSE_END = re.compile(r"[.\n?!]")
CODE = [re.compile(r"```.*?```", re.DOTALL), re.compile(r"`[^`]+?`")]
SENTENCE_END = re.compile(r"[.!?]\s+")
PARAGRAPH = re.compile(r"\n\n+")
CHUNK_SIZE = 512
MIN_CHUNK = 100
OVERLAP = 0.1

Span = tuple[int, int]


class Chunk(NamedTuple):
    chunk_id: int
    start_pos: int
    end_pos: int
    text: str


def math_regions(text: str) -> list[Span]:
    """formula spans, a superscript expression widened to its clause, overlaps merged."""
    spans = [m.span() for pattern in FORMULAS for m in pattern.finditer(text)]
    # The pattern starts at any letter; a text without a raised sign is not looked through for it.
    marks = [m.span() for m in SUPERSCRIPT.finditer(text)] if any(sign in text for sign in RAISED) else []
    if marks:
        ends = [m.start() for m in CLAUSE_END.finditer(text)]
        for start, end in marks:
            before, after = bisect_left(ends, start), bisect_left(ends, end)
            spans.append((ends[before - 1] + 1 if before else 0, ends[after] if after < len(ends) else len(text)))
    merged: list[Span] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def code_regions(text: str) -> list[Span]:
    """fenced and inline code, as found."""
    return [m.span() for pattern in CODE for m in pattern.finditer(text)]


def sentence_bounds(text: str) -> list[int]:
    """positions after a sentence and before a paragraph break, sorted."""
    return sorted({m.end() for m in SENTENCE_END.finditer(text)} | {m.start() for m in PARAGRAPH.finditer(text)})


class Regions:
    """Closed spans with a logarithmic "which is the first to hold this position"."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.reach = list(accumulate((end for _, end in self.spans), max))

    def first_at(self, position: int) -> Span | None:
        i = bisect_left(self.reach, position)
        if i < len(self.spans) and self.spans[i][0] <= position:
            return self.spans[i]
        return None


def cut_text(text: str, size: int = CHUNK_SIZE, overlap: float = OVERLAP, least: int = MIN_CHUNK) -> list[Chunk]:
    """the chunks of one text."""
    if len(text) < least:
        return [Chunk(0, 0, len(text), text)]
    shared = int(size * overlap)
    guarded = Regions(math_regions(text) + code_regions(text))
    bounds = [b for b in sentence_bounds(text) if guarded.first_at(b) is None]
    chunks: list[Chunk] = []
    here = 0
    while here < len(text):
        goal = here + size
        if goal >= len(text):
            chunks.append(Chunk(len(chunks), here, len(text), text[here:]))
            break
        region = guarded.first_at(goal)
        if region:
            goal = region[1]
        at = bisect_right(bounds, goal) - 1
        cut = bounds[at] if at >= 0 and bounds[at] > here else goal
        if cut == goal:
            space = text.rfind(" ", here, goal)
            cut = space if space > here else goal
        piece = text[here:cut].strip()
        if len(piece) >= least:
            chunks.append(Chunk(len(chunks), here, cut, piece))
        if cut <= here:
            cut = here + size
        behind = chunks[-1].start_pos if chunks else 0
        onward = cut - shared if cut - shared > behind else cut
        here = onward if onward > here else here + max(1, size // 2)
    return chunks


PIECE_CHARS = 1 << 20
CHUNKS = "array<struct<chunk_id: int, start_pos: int, end_pos: int, text: string>>"


def cut_batches(batches: Iterator[pd.Series], *size: int | float) -> Iterator[pd.Series]:
    """The chunks of each text, in pieces of the batches: a piece ends with the text that fills ``PIECE_CHARS``."""
    for texts in batches:
        made, held = [], 0
        for t in texts:
            made.append(None if t is None else [c._asdict() for c in cut_text(t, *size)])
            held += 0 if t is None else len(t)
            if held >= PIECE_CHARS:
                yield pd.Series(made, dtype=object)
                made, held = [], 0
        yield pd.Series(made, dtype=object)


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: float = OVERLAP, least: int = MIN_CHUNK) -> Column:
    """F25 as a Column: an array of chunks, null for a null text."""

    @F.pandas_udf(CHUNKS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from cut_batches(batches, size, overlap, least)

    return cut(text)


def regions_of(text: Column) -> Column:
    """F21 + F22 as a Column: kind, start and end of every region."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"kind": k, "start": a, "end": b} for k, spans in
                 (("math", math_regions(t)), ("code", code_regions(t))) for a, b in spans]
                for t in texts.fillna("")
            ],
            dtype=object,
        )

    return find(text)


def in_region(position: Column, regions: Column) -> Column:
    """closed at both ends."""
    return F.exists(regions, lambda r: position.between(r["start"], r["end"]))


def sentence_count(text: Column) -> Column:
    """F24 counted natively."""
    return F.regexp_count(text, F.lit(r"(?U)[.!?]\s+"))


def front_matter(content: Column) -> tuple[Column, Column]:
    """(metadata map, body). Without a closed ``---`` block: empty map, whole text."""
    parts = F.split(content, "---", 3)
    has = content.startswith("---") & (F.size(parts) == 3)
    lines = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda line: line.contains(":"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            strip(F.split_part(line, F.lit(":"), F.lit(1))).alias("key"),
            F.regexp_replace(strip(F.regexp_replace(line, r"^[^:]*:", "")), r"""^["']+|["']+$""", "").alias("value"),
        ),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["key"]) == 0)
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(has, F.map_from_entries(last)).otherwise(empty), F.when(
        has, strip(F.get(parts, F.lit(2)))
    ).otherwise(content)
