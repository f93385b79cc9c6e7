"""Operators that depend on what happened before, per key, in time order.

A key may hold a third of all rows, so nothing here puts a whole key into one
window or one group. Time is cut into buckets first; a bucket hands the next one
only what it needs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_SPAN = 64


def trailing_count(df: DataFrame, keys: list[str], us: str, span: int, name: str = "recent") -> DataFrame:
    """Rows of the same key in the ``span`` microseconds up to and including each row.

    Rows close to the end of a bucket are also shown to the next bucket.
    """
    width = span * BUCKETS_PER_SPAN
    bucket = F.floor(F.col(us) / width)
    late = F.pmod(F.col(us), F.lit(width)) > width - span
    copies = F.when(late, F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))))
    copies = F.coalesce(copies, F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own"))))
    spread = df.select("*", F.explode(copies).alias("_c")).select("*", "_c.b", "_c.own").drop("_c")
    recent = Window.partitionBy(*keys, "b").orderBy(us).rangeBetween(-(span - 1), 0)
    return spread.withColumn(name, F.count(F.lit(1)).over(recent)).where("own").drop("b", "own")


def with_runs(df: DataFrame, keys: list[str], us: str, gap: int) -> DataFrame:
    """Adds ``run``: the start of the row's unbroken run, one without a pause of ``gap`` or more.

    Whatever a key's state remembers for less than ``gap`` is forgotten between
    two runs, so runs of one key can be worked on apart.
    """
    width = gap * BUCKETS_PER_SPAN
    rows = df.withColumn("_b", F.floor(F.col(us) / width))
    ends = rows.groupBy(*keys, "_b").agg(F.max(us).alias("_before")).withColumn("_b", F.col("_b") + 1)
    inside = Window.partitionBy(*keys, "_b").orderBy(us)
    rows = rows.join(ends, [*keys, "_b"], "left").withColumn("_prev", F.coalesce(F.lag(us).over(inside), "_before"))
    # A bucket is wider than a gap: a previous row two buckets back is always a pause away.
    rows = rows.withColumn("_start", F.when(F.coalesce(F.col(us) - F.col("_prev") >= gap, F.lit(True)), F.col(us)))
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_here", F.max("_start").over(upto))
    carried = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_b").agg(F.max("_start").alias("_last"))
    starts = starts.withColumn("_carry", F.max("_last").over(carried)).drop("_last")
    return (
        rows.join(starts, [*keys, "_b"]).withColumn("run", F.coalesce("_here", "_carry"))
        .drop("_b", "_before", "_prev", "_start", "_here", "_carry")
    )


Step = Callable[[object, int], tuple[object, bool]]


def scan_runs(df: DataFrame, keys: list[str], us: str, tie: str, gap: int, step: Step, name: str) -> DataFrame:
    """Feed each key's rows to ``step(state, time)`` in time order; adds its answer as ``name``.

    Spark brings a run together and sorts it; the task walks the sorted rows one
    Arrow batch at a time and holds one state. A run is the smallest unit that
    can be worked on alone, since each answer depends on the one before.
    """
    rows = with_runs(df, keys, us, gap)
    ordered = rows.repartition(*keys, "run").sortWithinPartitions(*keys, "run", us, tie)
    group = [*keys, "run"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            answers = []
            for key, time in zip(batch[group].itertuples(index=False, name=None), batch[us]):
                if key != current:
                    current, state = key, None
                state, answer = step(state, time)
                answers.append(answer)
            yield batch.assign(**{name: answers})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.mapInPandas(run, f"{fields}, `{name}` boolean").drop("run")


def dump(state: deque) -> list[int]:
    """A state as a list of times, as streaming state stores it."""
    return [int(t) for t in state]


def restore(times: list[int]) -> deque:
    return deque(times)


def limit_step(span: int, limit: int) -> Step:
    """Accept while fewer than ``limit`` accepted requests are younger than ``span``.

    Rejected requests leave no trace.
    """

    def step(state, time):
        kept = state if state is not None else deque()
        while kept and time - kept[0] >= span:
            kept.popleft()
        if len(kept) >= limit:
            return kept, False
        kept.append(time)
        return kept, True

    return step


def ttl_step(ttl: int) -> Step:
    """R2: a request hits while the last fill is at most ``ttl`` old; a miss fills, a hit does not."""

    def step(state, time):
        if state and time - state[0] <= ttl:
            return state, True
        return deque([time]), False

    return step


def rate_limited(requests: DataFrame, key: str, us: str, tie: str, span: int = 60_000_000, limit: int = 10) -> DataFrame:
    """R3 over a table: adds ``accepted``."""
    return scan_runs(requests, [key], us, tie, span, limit_step(span, limit), "accepted")


def ttl_cached(requests: DataFrame, key: str, us: str, tie: str, ttl: int = 3_600_000_000) -> DataFrame:
    """R2 over a table: adds ``hit``."""
    return scan_runs(requests, [key], us, tie, ttl + 1, ttl_step(ttl), "hit")
