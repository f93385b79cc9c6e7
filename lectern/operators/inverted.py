"""An inverted file for vectors: rows stored by cell, questions put to few cells, and a bound that says when that is exact.

Cells come from k-means over all rows: a task sums the rows nearest to each centre, so a
round sends one row per task and cell. Rows are written in order of their cell, with the angle to its
centre. A question looks into its nearest cells by an equi-join on the cell; large cells and many
questions are met in blocks, so no pair is written and no cell sits in one task.

For unit vectors angles obey the triangle inequality: a row of a cell lies at least
(angle of question and centre) - (widest angle in the cell) away. Cells that cannot hold anything better than
the k-th best so far are done with; ``exact`` looks into all others, and the result is that of a full search.

The number of cells grows with the root of the number of rows up to ``CELLS``; the table of centres, at most ``CELLS`` rows,
is all that travels to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import blocks
from lectern.operators.layout import spread_small, written
from lectern.operators.retrieval import _unit, best_per_group

CELLS = 4096
ROUNDS = 8
PROBES = 8
SLACK = 1e-9
ASKED = 65_536


@dataclass
class Index:
    """``rows``: the given columns with ``cell`` and ``angle`` to its centre. Per cell: its centre, widest angle and number of rows."""

    rows: DataFrame
    centres: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column without nulls."""
    return _unit(pd.Series(column.to_numpy(zero_copy_only=False)))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and the cosine to it."""
    cell, cosine = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    for at in range(0, len(vectors), 1024):
        scores = vectors[at: at + 1024] @ centres.T
        cell[at: at + 1024] = scores.argmax(axis=1)
        cosine[at: at + 1024] = scores.max(axis=1)
    return cell, cosine


def centres_of(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the cells by spherical k-means over all rows of ``embedding``, from the rows of least hash."""
    first = vectors.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("embedding")).limit(cells)
    found = [r["embedding"] for r in first.select("embedding").distinct().collect()]
    if not found:
        return np.zeros((0, 1))
    centres = _unit(pd.Series(found))
    rows = vectors.select("embedding")
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _vectors(batch.column(0))
                    cell, _ = _nearest(x, centres)
                    np.add.at(total, cell, x)
                    n += np.bincount(cell, minlength=len(n))
            held = np.flatnonzero(n)
            yield pa.record_batch({"cell": pa.array(held), "sum": pa.array(list(total[held]), pa.list_(pa.float64()))})

        def added(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": group["cell"].iloc[:1], "sum": [np.sum(np.stack(group["sum"].to_numpy()), axis=0)]})

        schema = "cell long, sum array<double>"
        moved = rows.mapInArrow(sums, schema).groupBy("cell").applyInPandas(added, schema).collect()
        if not moved:
            break
        new = centres.copy()
        new[[r["cell"] for r in moved]] = _unit(pd.Series([np.array(r["sum"]) for r in moved]))
        centres, still = new, np.allclose(new, centres, atol=1e-6)
        if still:
            break
    return centres


def build(store: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> Index:
    """An index of every row of ``store`` that has an ``embedding``; all its columns are kept."""
    rows = store.where(F.col("embedding").isNotNull())
    if cells is None:
        cells = min(CELLS, max(1, round(2 * math.sqrt(rows.count()))))
    spread = spread_small(rows)
    centres = centres_of(spread, cells, rounds)
    if not len(centres):  # no rows, or zero vectors alone
        centres = np.zeros((1, max([len(r[0]) for r in rows.select("embedding").limit(1).collect()], default=1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, cosine = _nearest(_vectors(batch.column(batch.schema.get_field_index("embedding"))), centres)
                angle = np.arccos(np.clip(cosine, -1, 1))
                yield batch.append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = spread.mapInArrow(place, f"{fields}, cell long, angle double")
    # In order of the cell, so that a file holds few cells and its statistics tell which; a large cell may span files.
    held = written(placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell"), "cells")
    widest, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in held.groupBy("cell").agg(F.max("angle").alias("w"), F.count(F.lit(1)).alias("n")).collect():
        widest[r["cell"]], sizes[r["cell"]] = r["w"], r["n"]
    return Index(held, centres, widest, sizes)


def _cosines(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    """Cosine of each vector to each centre; an index without rows has a centre of no length."""
    unit = _unit(vectors)
    return unit @ centres.T if centres.shape[1] == unit.shape[1] else np.zeros((len(unit), len(centres)))


def _asked(queries: DataFrame, index: Index, probes: int | None) -> DataFrame:
    """The cells that each question looks into: the nearest ``probes``, or, with None, every other one that may hold better than ``edge``.

    An edge below any score (null) keeps all cells. Cells with no rows are left out.
    """
    centres, widest, held = index.centres, index.widest, index.sizes > 0
    columns = [c for c in queries.columns if c not in ("edge", "met")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A piece has at most ASKED (question, cell) pairs, and so rows: questions may look into every cell.
        few = max(1, ASKED // max(1, len(centres)))
        for batch in (whole.iloc[at: at + few] for whole in batches for at in range(0, len(whole), few)):
            cosine = _cosines(batch["query_embedding"], centres)
            order = np.argsort(np.where(held, -cosine, np.inf), axis=1, kind="stable")
            wanted = np.zeros(cosine.shape, bool)
            if probes is not None:
                np.put_along_axis(wanted, order[:, :probes], True, axis=1)
            else:
                angle = np.arccos(np.clip(cosine, -1, 1))
                best = np.cos(np.maximum(angle - widest, 0))
                edge = batch["edge"].fillna(-2.0).to_numpy()
                wanted = best >= edge[:, None] - SLACK
                np.put_along_axis(wanted, order[:, : int(batch["met"].iloc[0])], False, axis=1)
            row, cell = np.nonzero(wanted & held)
            yield batch[columns].iloc[row].assign(cell=cell)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*columns).schema)
    return spread_small(queries).mapInPandas(run, f"{fields}, cell long")


def _met(asked: DataFrame, index: Index, k: int, by: str | None, **limits: int) -> DataFrame:
    """The best k rows of each question in the cells asked (partial: not yet ranked across cells)."""
    keys = ["cell", *([by] if by else [])]

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for key, part in c.groupby(keys, sort=False):
            mine = q[(q[keys] == list(key)).all(axis=1)]
            if not len(mine):
                continue
            ids = part["vec_id"].to_numpy()
            own = mine["query_id"].to_numpy()
            rows, cols, values = best_per_group(_unit(mine["query_embedding"]), _unit(part["embedding"]), ids, k)
            found = {"query_id": own[rows], "vec_id": ids[cols], "score": values}
            parts.append(pd.DataFrame(found | ({by: key[1]} if by else {})))
        names = ["query_id", *([by] if by else []), "vec_id", "score"]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    items = index.rows.select("vec_id", "embedding", *keys)
    # Only cells that some question asks for are read; which ones is a small table.
    wanted = written(asked.select(*keys).distinct(), "asked-cells")
    items = items.join(wanted, keys, "left_semi")
    middle = f"`{by}` {dict(items.dtypes)[by]}, " if by else ""
    return blocks.cogroup_blocks(asked, items, score, f"query_id long, {middle}vec_id long, score double", keys, **limits)


def top_hits(
    queries: DataFrame, index: Index, k: int, probes: int = PROBES, exact: bool = False, by: str | None = None, **limits: int
) -> DataFrame:
    """The k nearest rows of each question by cosine, ties to the smaller vec_id.

    ``queries``: query_id, query_embedding and, with ``by``, that column: then a question's rows of that value are searched, and ranked
    apart from its others. ``index.rows`` has vec_id and, with ``by``, the same column. Returns
    query_id, ``by``, vec_id, score and rank. ``exact`` goes on with all cells that the bound leaves open.
    """
    group = ["query_id", *([by] if by else [])]
    queries = written(queries.select(*group, "query_embedding"), "questions")
    asked = written(_asked(queries, index, probes), "asked")
    ranked = _ranked(_met(asked, index, k, by, **limits), group, k)
    if not exact:
        return ranked
    ranked = written(ranked, "first-hits")
    edge = ranked.where(F.col("rank") == k).select(*group, F.col("score").alias("edge"))
    open_ = queries.join(edge, group, "left").withColumn("met", F.lit(probes))
    more = _met(written(_asked(open_, index, None), "asked-again"), index, k, by, **limits)
    return _ranked(ranked.drop("rank").unionByName(more), group, k)


def _ranked(partial: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_met(queries: DataFrame, index: Index, probes: int = PROBES) -> float:
    """The mean share of all rows that a question looks at."""
    looked = _asked(queries.select("query_id", "query_embedding"), index, probes).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    asked = queries.count()
    return sum(r["n"] * int(index.sizes[r["cell"]]) for r in looked) / max(1, asked * int(index.sizes.sum()))
