"""A cache of limited size and age over a table of requests: which hit, which fill, and what a fill pushes out.

Every answer depends on the answers before, of all keys. The state, though, is small: the
entries that are held. A shard's requests are numbered in order of time and cut into blocks of
equal size; every block is answered on its own from a guess of the state it starts with,
and hands its last state to the next block. Blocks that started from another state than
the one they were handed are answered again, until none is. The first blocks are right after the first
round, and a cache forgets what it started with, so that few rounds are needed; in the worst case
there is one a block, and results are those of a walk in any case.

The guess leaves the capacity out: it takes the fills of a cache that only forgets by age, which ``jumps`` finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import jumps
from lectern.operators.layout import number_rows, written

BLOCK_ROWS = 1 << 16
STATE = "array<struct<key:string,us:bigint>>"


class Cache:
    """Entries in order of their fill, with the time of it."""

    def __init__(self, capacity: int, ttl: int, entries: list[tuple[str, int]] = ()):
        self.capacity, self.ttl, self.held = capacity, ttl, dict(entries)

    def ask(self, key: str, us: int) -> tuple[bool, bool, str | None]:
        """(hit, expired, key pushed out): an expired entry goes and gives its place back; a miss fills."""
        filled = self.held.get(key)
        if filled is not None and us - filled <= self.ttl:
            return True, False, None
        self.held.pop(key, None)
        gone = None
        if len(self.held) >= self.capacity:
            gone = next(iter(self.held))
            del self.held[gone]
        self.held[key] = us
        return False, filled is not None, gone

    def entries(self) -> list[dict]:
        return [{"key": k, "us": t} for k, t in self.held.items()]


def _answers(rows: DataFrame, states: DataFrame, capacity: int, ttl: int, ends: bool) -> DataFrame:
    """The answer to each row, or the state after the last row of each block.

    ``rows``: block, shard, place, key, us. ``states``: block, shard and state that a block starts with. A
    block's state comes as a row before its requests, so a task holds one state at a time.
    """
    heads = states.select(
        "block", "shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("place"), F.lit("").alias("key"), F.lit(0).cast("long").alias("us"), "state"
    )
    asked = rows.select("block", "shard", F.lit(1).alias("kind"), "place", "key", "us", F.lit(None).cast(STATE).alias("state"))
    ordered = heads.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind", "place")
    names = ["block", "shard", "state"] if ends else ["place", "hit", "expired", "evicted"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, shard, head, cache = None, None, None, None
        for batch in batches:
            out = []
            for b, s, kind, place, key, us, state in batch.itertuples(index=False, name=None):
                if b != block:
                    if ends and cache is not None:
                        out.append((block, shard, cache.entries()))
                    block, shard, head, cache = b, None, None, None
                if kind == 0:
                    head = (s, [(e["key"], e["us"]) for e in state])
                    continue
                if cache is None or s != shard:
                    # Only the first shard of a block goes on from the block before.
                    goes_on = cache is None and head is not None and head[0] == s
                    cache, shard = Cache(capacity, ttl, head[1] if goes_on else ()), s
                answer = cache.ask(key, us)
                if not ends:
                    out.append((place, *answer))
            yield pd.DataFrame(out, columns=names)
        if ends and cache is not None:
            yield pd.DataFrame([(block, shard, cache.entries())], columns=names)

    schema = f"block long, shard string, state {STATE}" if ends else "place long, hit boolean, expired boolean, evicted string"
    return ordered.mapInPandas(run, schema)


def _guess(rows: DataFrame, fills: DataFrame, capacity: int) -> DataFrame:
    """The state after each block, from the block's fills alone and as if only age counted."""
    last = rows.join(fills, "place", "left_semi").groupBy("block", "shard", "key").agg(F.max(F.struct("place", "us")).alias("l"))
    newest = Window.partitionBy("block", "shard").orderBy(F.desc("l.place"))
    kept = last.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= capacity)
    listed = F.array_sort(F.collect_list(F.struct("l.place", "key", "l.us")))  # at most ``capacity``
    states = kept.groupBy("block", "shard").agg(F.transform(listed, lambda e: F.struct(e["key"].alias("key"), e["us"].alias("us"))).alias("state"))
    ends = rows.groupBy("block").agg(F.max_by("shard", "place").alias("shard"))
    return ends.join(states, ["block", "shard"], "left").withColumn("state", F.coalesce("state", F.array().cast(STATE)))


def _settled(rows: DataFrame, ends: DataFrame, capacity: int, ttl: int) -> tuple[DataFrame, int]:
    """The state that each block starts with, once no block hands on another; and the rounds it took."""
    following = lambda e: e.select((F.col("block") + 1).alias("block"), "shard", "state")
    states = written(following(ends), "states")
    ends = written(_answers(rows, states, capacity, ttl, ends=True), "ends")
    rounds = 1
    while True:
        handed = following(ends)
        known = states.select("block", F.col("shard").alias("_s"), F.col("state").alias("_e"))
        other = handed.join(known, "block", "left").where("NOT (shard <=> _s AND state <=> _e)").select(handed.columns)
        other = written(other, "handed")
        again = other.select("block")
        if not other.limit(1).count():
            return states, rounds
        states = written(states.join(again, "block", "left_anti").unionByName(other), "states")
        redone = _answers(rows.join(again, "block", "left_semi"), other, capacity, ttl, ends=True)
        ends = written(ends.join(again, "block", "left_anti").unionByName(redone), "ends")
        rounds += 1


def cached(
    requests: DataFrame, shard: str, key: str, us: str, tie: str, capacity: int = 100, ttl: int = 3_600_000_000, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """R4 + R2: adds ``hit``, ``expired`` (the key was held, but too old) and ``evicted`` (the key that the fill pushes out).

    Every ``shard`` has a cache of its own with room for ``capacity`` keys. A request hits
    while its key is held and was filled at most ``ttl`` ago; else it fills. A fill into a full cache
    pushes out the oldest fill, whether expired or not. Of requests at one time the first by ``tie`` comes first.
    Shards and keys are compared as text; null ones are values like any other.
    """
    of = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    numbered = number_rows(requests.withColumns({"_shard": of(shard), "_key": of(key)}), ["_shard", us, tie], "_place")
    numbered = written(numbered, "numbered")
    rows = numbered.select(
        F.floor(F.col("_place") / block_rows).cast("long").alias("block"), F.col("_shard").alias("shard"), F.col("_place").alias("place"),
        F.col("_key").alias("key"), F.col(us).cast("long").alias("us"),
    )
    by_age = jumps.ttl_cached(rows, ["shard", "key"], "us", "place", ttl, block_rows)
    fills = written(by_age.where("NOT hit").select("place"), "fills")
    states, _ = _settled(rows, _guess(rows, fills, capacity), capacity, ttl)
    answers = _answers(rows, states, capacity, ttl, ends=False).withColumnRenamed("place", "_place")
    said = F.when(F.col("evicted") != "", F.substring("evicted", 2, (1 << 31) - 1))
    return numbered.join(answers, "_place").withColumn("evicted", said).drop("_place", "_shard", "_key")
