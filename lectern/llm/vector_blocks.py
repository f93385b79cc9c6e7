"""What both vector searches share: clean vectors, blocks of queries against blocks of rows, and the merge of their best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 8192, 2048


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: no null or non-finite components, one per vec_id.

    Of several vectors with one vec_id the least stands; a null vec_id takes no part.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").where(finite)
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))


def stacked(values: pd.Series, kind: type = float) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    width = max(map(len, values))
    out = np.zeros((len(values), width), kind)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def bounded_block(key: Column, n: int, size: int) -> tuple[Column, int]:
    """A block number for each key so that blocks of ``n`` rows in all hold about ``size``."""
    blocks = max(1, -(-n // size))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), blocks


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query, ties to smaller vec_id."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def met(queries: DataFrame, rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, pd.DataFrame], list], kind: str) -> DataFrame:
    """Each block of queries with each block of rows of the same keys; ``fn`` gives (query_id, vec_id, score)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = fn(left, right) if len(left) and len(right) else []
        table = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return table.astype({"query_id": "int64", "vec_id": "int64", "score": "int64" if kind == "long" else "float64"})

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {kind}")
