"""A time-limited cache over keys of any size, by pointer doubling.

Which requests fill the cache looks like a chain that has to be walked: a fill at t is followed
by the first request later than t + ttl. But that successor is known for every
request before any fill is, so the chain is a path in a graph of pointers. Requests are
numbered in the order (key, time) and cut into blocks of equal size, whatever their
keys. A block shortens every path through it to one step; paths over many
blocks are followed by doubling, in rounds logarithmic in the blocks of a key.
A key with all the rows, without a single pause, is spread like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.layout import largest_so_far, number_rows, written

BLOCK_ROWS = 1 << 16


def successors(numbered: DataFrame, keys: list[str], us: str, ttl: int) -> DataFrame:
    """(number, next, first): the number of the first request of the key later than ``ttl`` after each, null if none."""
    events = numbered.select(*keys, F.col(us).alias("_t"), F.lit(0).alias("_kind"), F.col("number"), F.lit(None).cast("long").alias("_asks"))
    asks = numbered.select(
        *keys, (F.col(us) + ttl).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("number"), F.col("number").alias("_asks")
    )
    # A request at exactly t + ttl still hits, so it comes before the question.
    both = largest_so_far(events.unionByName(asks), [*keys, "_t", "_kind"], "number", "_seen").where("_kind = 1")
    spans = written(numbered.groupBy(*keys).agg(F.min("number").alias("_first"), F.max("number").alias("_last")), "spans")
    spans = spans.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    after = F.when(F.col("_seen") < F.col("_last"), F.col("_seen") + 1)
    return both.join(spans, same).select(F.col("_asks").alias("number"), after.alias("next"), (F.col("_asks") == F.col("_first")).alias("first"))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where a path that comes to each row leaves the block; null where it ends inside."""
    rows = rows.sort_values("number", ignore_index=True)
    base, n = int(rows["number"].iloc[0]), len(rows)
    ahead = rows["next"].fillna(-1).astype("int64").to_numpy()
    out = ahead.copy()
    for i in range(n - 1, -1, -1):
        if 0 <= ahead[i] - base < n:
            out[i] = out[ahead[i] - base]
    return pd.DataFrame({"number": rows["number"], "next": pd.array(np.where(out < 0, 0, out), "Int64").copy()}).assign(
        next=lambda d: d["next"].mask(out < 0)
    )


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows on the paths that enter the block at the rows marked ``entry``."""
    rows = rows.sort_values("number", ignore_index=True)
    base, n = int(rows["number"].iloc[0]), len(rows)
    ahead = rows["next"].fillna(-1).astype("int64").to_numpy()
    fill = np.zeros(n, bool)
    for i in np.flatnonzero(rows["entry"].to_numpy()):
        while 0 <= i < n and not fill[i]:
            fill[i] = True
            i = ahead[i] - base if ahead[i] >= 0 else -1
    return pd.DataFrame({"number": rows["number"], "fill": fill})


def on_paths(pointers: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(number, fill): whether a row lies on a path from a ``first`` row. ``pointers``: number, next (larger, or null), first.

    Numbers are those of ``number_rows``, without gaps, so a block has at most ``block_rows`` rows.
    """
    block = F.floor(F.col("number") / block_rows).alias("block")
    rows = written(pointers.select(block, "number", "next", "first"), "pointers")
    leaves = rows.groupBy("block").applyInPandas(_exits, "number long, next long")
    leaves = written(leaves, "exits")
    reached = written(rows.where("first").select("number"), "reached")
    ends = leaves.where("next IS NOT NULL")
    met = ends.select(F.col("next").alias("number")).unionByName(reached).distinct()
    jumps = written(ends.join(met, "number", "left_semi"), "jumps")
    blocks = (rows.agg(F.max("number").alias("n")).first()["n"] or 0) // block_rows + 1
    for _ in range(math.ceil(math.log2(blocks + 1))):
        found = reached.join(jumps, "number").select(F.col("next").alias("number"))
        before, reached = reached, written(reached.unionByName(found).distinct(), "reached")
        if reached.count() == before.count():
            break
        further = jumps.select(F.col("number").alias("next"), F.col("next").alias("then"))
        jumps = written(jumps.join(further, "next").select("number", F.col("then").alias("next")), "jumps")
    marked = rows.join(reached.withColumn("entry", F.lit(True)), "number", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.select("block", "number", "next", "entry").groupBy("block").applyInPandas(_walked, "number long, fill boolean")


def ttl_cached(requests: DataFrame, keys: list[str], us: str, tie: str, ttl: int = 3_600_000_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """R2: adds ``hit``: whether the last fill of the key is at most ``ttl`` old; a miss fills, a hit does not.

    Of requests at one time the first by ``tie`` asks first. A null key is a key like any other.
    """
    numbered = written(number_rows(requests, [*keys, us, tie]), "requests")
    fills = on_paths(successors(numbered, keys, us, ttl), block_rows)
    return numbered.join(fills, "number").withColumn("hit", ~F.col("fill")).drop("number", "fill")
