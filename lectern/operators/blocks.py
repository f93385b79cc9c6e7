"""Match every probe row against many item rows without emitting the pairs.

Similarity and fuzzy search compare a batch of probes (questions) with a large
table of items (chunks, concepts). A join would write one row per pair. Here a
task receives a block of items together with a block of probes, scores the block
in memory and returns only its best rows per probe and key; a row_number over
that small partial result finishes the job. Nothing is dropped: a row outside a
block's best k cannot be in the overall best k.

Two layouts give the same rows:

* the probes fit a checked bound: every task over the items, wherever they lie,
  gets a copy of the probes; the items are neither shuffled nor copied;
* otherwise both sides are cut into hash blocks. Items go to (probe block, item
  block) once per probe block, and a cogroup meets each pair of blocks once. The
  number of blocks per key comes from a count, so a key that holds a third of
  all rows is cut into as many blocks as its size asks for. A row is copied once
  per block of the other side, so blocks may be let grow with their key: up to
  ``BLOCK_ROWS`` rows a key has at most ``BLOCKS`` of them on a side, and fewer
  where the other side alone makes enough pairs of blocks to keep tasks busy.

Vector scores look at a block in ``tiles``, so their matrices stay small however large the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import layout

Score = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
Trim = Callable[[pd.DataFrame], pd.DataFrame]

PROBE_ROWS = 4096
PROBE_BYTES = 64 << 20
BLOCKS, BLOCK_ROWS = 8, 65_536
TILE_ROWS, TILE_COLUMNS = 512, 2048


def tiles(rows: int, columns: int) -> Iterator[tuple[slice, slice]]:
    """A matrix in parts of bounded size, all columns of some rows before the next rows."""
    for top in range(0, rows, TILE_ROWS):
        for left in range(0, columns, TILE_COLUMNS):
            yield slice(top, min(top + TILE_ROWS, rows)), slice(left, min(left + TILE_COLUMNS, columns))


def match_blocks(
    probes: DataFrame,
    items: DataFrame,
    score: Score,
    schema: str,
    keys: list[str] = (),
    trim: Trim | None = None,
    probe_rows: int = PROBE_ROWS,
    probe_bytes: int = PROBE_BYTES,
    item_rows: int = 50_000,
    grown: int = 0,
) -> DataFrame:
    """Partial best rows of every block pair.

    ``score(probe_block, item_block)`` returns rows of ``schema``. With ``keys``
    the score function itself compares only rows of equal key; the key columns
    must be in both inputs. ``trim`` cuts rows collected so far in a task back to
    the best per probe, so a task holds and returns no more than one block's
    worth however many items it reads. ``grown``: blocks may grow to this many rows
    rather than be more than ``BLOCKS`` a key; for scores that work in ``tiles``.
    The result is partial: rank it once more.
    """
    held = fetch_small(probes, probe_rows, probe_bytes)
    if held is not None:
        return _near_items(items, held, score, schema, trim, item_rows)
    return cogroup_blocks(probes, items, score, schema, list(keys), probe_rows, item_rows, grown)


def fetch_small(df: DataFrame, rows: int, size: int) -> pd.DataFrame | None:
    """The whole of ``df`` when it is within both bounds, else None.

    Two bounded jobs: no more than ``rows + 1`` rows are looked at to decide,
    and none reach the driver before their number and bytes are known.
    """
    seen = df.limit(rows + 1).select(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")
    ).first()
    if seen["n"] > rows or seen["b"] > size:
        return None
    return df.toPandas()


def _near_items(
    items: DataFrame, held: pd.DataFrame, score: Score, schema: str, trim: Trim | None, item_rows: int
) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast(held)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= item_rows:
                yield pd.concat(waiting, ignore_index=True)
                waiting, n = [], 0
        if n:
            yield pd.concat(waiting, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for block in blocks(batches):
            found = score(shared.value, block)
            if trim is None:
                yield found
            else:
                best = found if best is None else trim(pd.concat([best, found], ignore_index=True))
        if best is not None:
            yield best

    return items.mapInPandas(run, schema)


def cogroup_blocks(
    probes: DataFrame, items: DataFrame, score: Score, schema: str, keys: list[str], probe_rows: int = PROBE_ROWS, item_rows: int = 50_000,
    grown: int = 0,
) -> DataFrame:
    """The second layout: both sides in blocks of bounded size per key, each pair of blocks met once."""
    sizes, other = _block_counts(probes, keys, probe_rows, grown, "_np"), _block_counts(items, keys, item_rows, grown, "_ni")
    counts = (sizes.join(other, keys) if keys else sizes.crossJoin(other)).select(
        *keys, _fewer("_np", "_ni").alias("_np"), _fewer("_ni", "_np").alias("_ni")
    )
    # A row a key: written, so that neither side is shuffled for it by a key that may be hot.
    counts = layout.written(counts, "blocks")
    if keys:
        left, right = probes.join(counts, keys), items.join(counts, keys)
    else:
        add = {name: F.lit(n) for name, n in counts.first().asDict().items()}
        left, right = probes.withColumns(add), items.withColumns(add)

    def spread(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        cols = df.columns
        # Columns of their own: both sides may come from one table, and a cogroup takes columns by identity.
        df = df.select(*[F.col(c).alias(c) for c in cols])
        return df.withColumn(own, F.pmod(F.xxhash64(*[c for c in cols if c not in ("_np", "_ni")]), F.col(own_n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), (F.col(other_n) - 1).cast("long")))
        ).drop("_np", "_ni")

    group = [*keys, "_pb", "_ib"]
    left = spread(left, "_pb", "_np", "_ib", "_ni")
    right = spread(right, "_ib", "_ni", "_pb", "_np")

    def run(p: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if len(p) and len(i):
            return score(p.drop(columns=["_pb", "_ib"]), i.drop(columns=["_pb", "_ib"]))
        return pd.DataFrame()

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
        lambda p, i: _shaped(run(p, i), schema), schema
    )


def _shaped(df: pd.DataFrame, schema: str) -> pd.DataFrame:
    if len(df.columns):
        return df
    return pd.DataFrame(columns=[part.strip().split(" ")[0] for part in schema.split(",")])


def _block_counts(df: DataFrame, keys: list[str], block: int, grown: int, name: str) -> DataFrame:
    """The blocks of each key, and how few they may be."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    n = F.count(F.lit(1))
    size = F.greatest(F.lit(block), F.least(F.ceil(n / BLOCKS), F.lit(grown)))
    least = F.ceil(n / max(block, grown))
    return grouped.agg(F.greatest(F.lit(1), F.ceil(n / size)).alias(name), F.greatest(F.lit(1), least).alias(f"{name}_least"))


def _fewer(own: str, other: str) -> Column:
    """No more blocks than make ``BLOCKS`` squared pairs with those of the other side, as far as blocks may grow."""
    return F.greatest(F.col(f"{own}_least"), F.least(F.col(own), F.ceil(F.lit(BLOCKS * BLOCKS) / F.col(other))))
