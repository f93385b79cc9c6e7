"""Audit of how filters interact: what each removes, at every place of every order.

A document's mask says which of the filters it fails. Where the order of two filters does
not change what they see, a row is removed at the least place that a failed
filter has in the order: the min-plus product of the masks (0 where a filter fails, infinite elsewhere)
with the inverse permutations (place of each filter in each order). Those removal steps say
where the documents of a mask are counted: as removed, as kept after a step, or as
redundant for a filter that comes too late.

Documents meet in one row per part, mask and pair of labels before anything else: at most 2**filters * 4 rows a
part, of which a task computes the whole report of that part.

Defined results: a null text is empty; a null source is the part ''. A null doc_id fails
no comparison with smaller doc_ids and has no label. Rows that repeat a doc_id each count; of several labels of a doc_id any 1 counts.
An empty table has no parts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import stored
from lectern.llm.words import Words, pieces

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True

REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def distinct_words(words: Words) -> np.ndarray:
    """Number of different words of each text; words are compared by their bytes."""
    size = words.end - words.start
    inside = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    letters = words.data[np.cumsum(inside[:-1]) > 0]
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    code = every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    pairs = np.unique(text * (len(size) + 1) + code)
    return np.bincount(pairs // (len(size) + 1), minlength=len(words.counts))


def text_mask(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3: which of the filters A to D each text fails."""
    words = Words(texts)
    n = len(words.counts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[words.text_at[1:]] - total[words.text_at[:-1]]

    points = per_text((words.data & 0xC0) != 0x80)
    fails = [
        words.counts < LEAST_WORDS,
        100 * distinct_words(words) < LEAST_DISTINCT_PERCENT * words.counts,
        100 * per_text(_CAPITAL[words.data]) > MOST_CAPITALS_PERCENT * points,
        per_text(_SYMBOL[words.data]) > 0,
    ]
    return sum((f.astype(np.int32) << k for k, f in enumerate(fails)), np.zeros(n, np.int32))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of (doc_id, text, source); a row's text is read once.

    Texts that are equal are found by their SHA-256; the least doc_id of a text is aggregated
    before the shuffle, and only texts that occur again are joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = pc.fill_null(batch.column(1), "")
            yield pa.record_batch({
                "doc_id": batch.column(0), "part": batch.column(2), "mask": pa.array(text_mask(texts)),
                "digest": pa.array([hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in texts], pa.binary()),
            })

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("source", F.lit("")))
    rows = stored(rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary"), "masks")
    again = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    again = stored(again.select("digest", "least"), "copies")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(again, "digest", "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask")
    )


def weights(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of ``marked`` by part, mask and labels."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return marked.join(known, "doc_id", "left").select("part", "mask", *flags).groupBy("part", "mask", "good", "toxic").agg(
        F.count(F.lit(1)).alias("n")
    )


def removal_steps(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Step (from 0) at which each mask goes in each order; infinite where it stays.

    ``places``: filters x orders, the place of each filter in each order.
    """
    cost = np.where((mask[:, None] >> np.arange(len(places))) & 1, 0.0, np.inf)
    steps = np.full((len(mask), places.shape[1]), np.inf)
    for f in range(len(places)):
        np.minimum(steps, cost[:, f, None] + places[f], out=steps)
    return steps


def report(rows: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """The report of one part from its (mask, good, toxic, n): a row for every order and step."""
    k = len(filters)
    orders = np.array(list(permutations(range(k))))
    places = np.argsort(orders, axis=1).T
    mask, n = rows["mask"].to_numpy(), rows["n"].to_numpy()
    step = removal_steps(mask, places)
    at = np.arange(len(orders))

    def scatter(weight: np.ndarray) -> np.ndarray:
        """Documents removed, by order and step; a last column holds those that stay."""
        out = np.zeros((len(orders), k + 1), np.int64)
        np.add.at(out, (np.broadcast_to(at, step.shape), np.where(np.isinf(step), k, step).astype(int)), weight[:, None])
        return out[:, :k]

    removed = scatter(n)
    good, toxic = scatter(n * rows["good"].to_numpy()), scatter(n * rows["toxic"].to_numpy())
    kept = n.sum() - np.cumsum(removed, axis=1)
    fails = ((mask[:, None] >> np.arange(k)) & 1).astype(bool)
    only = n @ (fails & (fails.sum(axis=1) == 1)[:, None])
    # Redundant: the filter's own place comes after the step that removed the document.
    late = np.stack([n @ (fails[:, f, None] & (step < places[f])) for f in range(k)])
    own = np.stack([removed[at, places[f]] for f in range(k)]).sum(axis=1)
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(filters[f] for f in order) for order in orders], k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "kept": kept.ravel(), "removed": removed.ravel(), "redundant": late[orders, at[:, None]].ravel(), "unique_fails": only[orders].ravel(),
        "good_lost": good.ravel(), "toxic_lost": toxic.ravel(), "shapley": own[orders].ravel(),
    })


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of every part of (part, mask, good, toxic, n): k! * k rows a part for k filters."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = report(rows, filters)
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    return counts.groupBy("part").applyInPandas(run, REPORT)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return interactions(weights(masks(docs), labels))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), fails AS (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM split
), known AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), weights AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL
), orders AS (
  SELECT [a, b, c, d, e] AS o FROM range(1, 6) x(a), range(1, 6) y(b), range(1, 6) z(c), range(1, 6) u(d), range(1, 6) v(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), removals AS (
  SELECT part, f, good, toxic, n, o, list_position(list_transform(o, lambda x: f[x]), true) AS gone FROM weights, orders
), audit AS (
  SELECT part, o, s.step, o[s.step] AS x,
    coalesce(sum(n) FILTER (gone IS NULL OR gone > s.step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = s.step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (f[o[s.step]] AND gone < s.step), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f[o[s.step]] AND len(list_filter(f, lambda y: y)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (gone = s.step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (gone = s.step AND toxic), 0)::BIGINT AS toxic_lost
  FROM removals, range(1, 6) s(step) GROUP BY part, o, s.step
)
SELECT part, array_to_string(list_transform(o, lambda y: chr((64 + y)::INTEGER)), '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails,
  good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM audit
"""
