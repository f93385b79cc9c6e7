"""Exact top-k by inner product with a pivot table.

The distances of every vector to ``PIVOTS`` pivots are computed once. For a query q and
a row x the largest |d(q, p) - d(x, p)| over all pivots p is a lower bound of d(q, x),
and with 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 an upper bound of the score. A query's rows
are evaluated in order of that bound, until it falls below the k-th score found; a row
whose bound equals it is still evaluated, as it may tie with a smaller id.

All queries meet all rows in blocks of bounded size; a block hands on k rows per query.
Vectors are integers and scores exact: products are summed in doubles only where every
sum stays below 2**53, else in 64-bit integers.

Defined results: null vectors and those with null or non-finite components take no
part, nor does a null vec_id; of repeated vec_ids one row stands; shorter vectors end
in zeros; fewer rows than k are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import stored
from lectern.llm.vector_blocks import QUERIES, ROWS, best, bounded_block, clean, met, stacked, top_rows

PIVOTS = 32


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if largest < 2**53 else a @ b.T


def distances(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norm[:, None] + dots(pivots, pivots).diagonal()[None, :] - 2 * dots(x, pivots), 0))


def pivot_table(vectors: DataFrame, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, v, norm, d): the integer vector, its squared length and its distances to the pivots."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = stored(clean(vectors).select("vec_id", whole.alias("v")), "integers")
    # The pivots are the vectors of least hash: as good as drawn at random, and the same in every run.
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()
    table = stacked(chosen["v"], np.int64) if len(chosen) else np.zeros((1, 1), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = stacked(batch["v"], np.int64)
                norm = np.array([int(v @ v) for v in x])
                yield batch.assign(norm=norm, d=list(distances(x, norm, table)))

    return stored(rows.mapInPandas(run, "vec_id long, v array<long>, norm long, d array<double>"), "pivots")


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple]:
    x, ids, norm = stacked(rows["v"], np.int64), rows["vec_id"].to_numpy(), rows["norm"].to_numpy(float)
    far = np.stack(rows["d"].to_numpy())
    out = []
    for q_id, v, q_norm, d in zip(queries["vec_id"], queries["v"], queries["norm"], queries["d"]):
        lower = np.abs(far - d[None, :]).max(axis=1)
        # Rounding of the square roots may not lift the bound above the truth.
        lower = np.maximum(lower - 1e-9 * (1 + lower + d.max()), 0)
        upper = np.floor((q_norm + norm - lower * lower) / 2 + 1e-9 * (q_norm + norm)) + 1
        upper[ids == q_id] = -np.inf
        order = np.argsort(-upper, kind="stable")
        order = order[: len(order) - int((ids == q_id).sum())]
        own = np.asarray(v, np.int64)[None, :]
        at, step, scores, places = 0, 4 * k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < len(order):
            if len(scores) >= k and upper[order[at]] < scores.min():
                break
            some = order[at: at + step]
            scores, places = np.r_[scores, dots(own, x[some])[0]], np.r_[places, some]
            keep = top_rows(scores, ids[places], k)
            scores, places = scores[keep], places[keep]
            at, step = at + step, step * 2
        out += [(q_id, ids[p], s) for p, s in zip(places, scores)]
    return out


def exact_top(vectors: DataFrame, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that ``is_query`` picks, against all others."""
    table = pivot_table(vectors, scale)
    queries = table.where(is_query)
    row_block, row_blocks = bounded_block(F.col("vec_id"), table.count(), ROWS)
    query_block, query_blocks = bounded_block(F.col("vec_id"), queries.count(), QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = met(
        queries.withColumn("i", query_block).withColumn("j", every(row_blocks)),
        table.withColumn("j", row_block).withColumn("i", every(query_blocks)),
        ["i", "j"], lambda q, r: search_block(q, r, k), "long",
    )
    return best(found, k)


def op9_exact_top5(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5
"""
