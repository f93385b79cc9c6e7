"""Texts that resemble a query or hold its words, without comparing every query with every text.

Both searches work on different texts and different queries only; what they are attached to is joined at the end.

* All words held: a query is filed under one run of up to three letters of its words, the one that
  fewest texts have. Texts that have that run are looked at, by native string functions.
* Similarity over a ratio: matched letters are at most the letters in common, which are at most the shorter length. So a
  query meets the length classes that it can reach, by an equi-join; within a class letter counts of a whole block rule
  out most pairs at once, the longest common subsequence (matched blocks are one) most of the rest, and
  only what is left gets the ratio itself.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.words import GRAM, grams, letters, words
from lectern.operators import blocks
from lectern.operators.layout import written

CLASS = 1.2
BUCKETS = 97
QUERY_ROWS, TEXT_ROWS = 256, 2048


def word_hits(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, text) for every text that holds all words of a query. ``queries``: query; ``texts``: text; both distinct.

    A query without words holds in no text.
    """
    asked = queries.select("query", words(F.col("query")).alias("words")).where(F.size("words") > 0)
    spelt = asked.select("query", F.explode("words").alias("word")).distinct().withColumn("letters", letters(F.col("word")))
    own = F.when(F.size("letters") >= GRAM, grams(F.col("letters"), GRAM)).otherwise(F.array("word"))
    filed = written(spelt.select("query", F.explode(own).alias("gram")).distinct(), "query-grams")
    wanted = written(filed.select("gram").distinct(), "grams")
    held = texts.select("text", letters(F.col("text")).alias("letters"))
    runs = F.array_distinct(F.concat(*[grams(F.col("letters"), n) for n in range(1, GRAM + 1)]))
    met = written(held.select(F.md5("text").alias("key"), F.explode(runs).alias("gram")).join(wanted, "gram", "left_semi"), "text-grams")
    rated = filed.join(met.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    best = rated.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b")).where("b.n > 0")
    maybe = met.join(best.select("query", F.col("b.gram").alias("gram")), "gram").select("key", "query")
    pairs = maybe.join(asked, "query").join(texts.select(F.md5("text").alias("key"), "text"), "key")
    return pairs.where(F.forall("words", lambda w: F.contains("text", w))).select("query", "text")


def _class(length: Column) -> Column:
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / math.log(CLASS)).cast("int")


def _profile(texts: list[str]) -> np.ndarray:
    """Letter counts of each text; letters that share a bucket count together, which only raises what two have in common."""
    out = np.zeros((len(texts), BUCKETS), np.int32)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out[i] = np.bincount(codes % BUCKETS, minlength=BUCKETS)
    return out


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """At least the number of letters that each pair of texts has in common."""
    x, y = _profile(a), _profile(b)
    total = np.zeros((len(a), len(b)), np.int32)
    for k in np.flatnonzero(x.any(axis=0) & y.any(axis=0)):
        total += np.minimum(x[:, k, None], y[:, k])
    return total


def subsequence(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a letter of ``a`` at a time for all of ``b`` at once."""
    places = letter_places(b) if places is None else places
    full = (1 << len(b)) - 1
    rest = full
    for letter in a:
        hit = rest & places.get(letter, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(b) - rest.bit_count()


def letter_places(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, letter in enumerate(text):
        out[letter] = out.get(letter, 0) | 1 << i
    return out


def over_ratio(queries: list[str], texts: list[str], floor: float) -> tuple[list[tuple[int, int]], int]:
    """Pairs whose ratio is over ``floor``, and the number of pairs for which it was worked out."""
    size = np.array([len(q) for q in queries])[:, None] + np.array([len(t) for t in texts])
    near = 2 * common_letters(queries, texts) > floor * size
    found, tried = [], 0
    for j in np.flatnonzero(near.any(axis=0)):
        places, matcher = letter_places(texts[j]), SequenceMatcher(None, "", texts[j])
        for i in np.flatnonzero(near[:, j]):
            if 2 * subsequence(queries[i], texts[j], places) <= floor * size[i, j]:
                continue
            tried += 1
            matcher.set_seq1(queries[i])
            if matcher.ratio() > floor:
                found.append((int(i), int(j)))
    return found, tried


def ratio_hits(queries: DataFrame, texts: DataFrame, floor: float, **limits: int) -> DataFrame:
    """(query, text) for every pair with a similarity ratio over ``floor``, which is above 0. Inputs as in ``word_hits``."""
    size = F.length("query")
    # 2 * min / (a + b) > floor bounds the other length on both sides; a class more on each end allows for rounding.
    low, high = size * floor / (2 - floor), size * (2 - floor) / floor
    asked = queries.where(size > 0).withColumn("class", F.explode(F.sequence(_class(low) - 1, _class(high) + 1)))
    items = texts.where(F.length("text") > 0).withColumn("class", _class(F.length("text")))

    def score(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, part in t.groupby("class", sort=False):
            mine = q[q["class"] == key]
            if len(mine):
                asked, held = mine["query"].tolist(), part["text"].tolist()
                out += [(asked[i], held[j]) for i, j in over_ratio(asked, held, floor)[0]]
        return pd.DataFrame(out, columns=["query", "text"])

    return blocks.cogroup_blocks(asked, items, score, "query string, text string", ["class"], **({"probe_rows": QUERY_ROWS, "item_rows": TEXT_ROWS} | limits))
