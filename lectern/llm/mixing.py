"""Mixing sources to target weights, block by block.

The words of a source, document after document, are packed into blocks of fixed
length. Every output shard draws a multinomial number of slots per source; the
k-th slot that a source gets over all shards takes the block to which a
pseudorandom permutation of the source's block numbers maps k, a new permutation
for each pass over the source, and blocks are joined by number. What independent
draws give a source beyond its quota goes to the sources below theirs, slot by
slot, so targets are met to a block and no block is taken more than twice.

Nothing is grouped by source alone but one row per source and slice: offsets are
running totals over hashed slices, so a source that holds a third of all rows, or one doc_id
in all of them, is spread like any other. One row per source reaches the driver: a mixture's
sources and weights are its configuration.

Defined results: a null text has size 0; a null source is a source, the last;
repeated rows and null doc_ids count as rows of their own; a source without words
has target 0. Other columns are ignored by the plan and kept with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.prefix import running_total
from lectern.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK = 128
SHARD = 4096
SLICE = 4096
TASK_SLOTS = 1 << 16


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source: number (by code point, null last), source_size and target.

    A target stops at twice its source's size and the excess is shared by weight
    among the others. With sources ordered by limit / weight, the level is the first
    one that its own source, and so all after it, can take.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    one = one.withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    one = one.withColumn("limit", F.col("source_size") * REPEAT).withColumn("ratio", F.col("limit") / F.col("weight"))
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = F.sum("source_size").over(every) * share
    one = one.withColumn("level", (asked - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(every)["level"]
    target = F.least(F.col("limit").cast("double"), F.col("weight") * level)
    return one.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "number", "source_size", "target")


def permuted(index: np.ndarray, size: int, key: tuple[int, ...]) -> np.ndarray:
    """A pseudorandom permutation of range(size): four Feistel rounds, walked until the value is below ``size``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 64, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & low)
        out[walk] = left << np.uint64(half) | right
        walk = out >= size
    return out.astype(np.int64)


def draws(spark: SparkSession, quota: np.ndarray, seed: int) -> DataFrame:
    """(shard, number, n): slots drawn for each source in each shard."""
    total = int(quota.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                slots = min(SHARD, total - shard * SHARD)
                n = np.random.default_rng((seed, shard)).multinomial(slots, quota / total)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"shard": shard, "number": some, "n": n[some]})

    return spark.range(-(-total // SHARD)).mapInPandas(run, "shard long, number long, n long")


def slots(drawn: DataFrame, quota: np.ndarray, got: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    """(shard, slot, number, pass, block) for every slot of the mix. ``drawn`` has ``first``, the source's slots in shards before."""
    over, under = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    over_at, under_at = np.r_[0, np.cumsum(over)], np.r_[0, np.cumsum(under)]

    def of(number: int, k: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The slots that stay with the source, and what each one beyond its quota becomes."""
        yield number, k[k < quota[number]]
        unit = over_at[number] + k[k >= quota[number]] - quota[number]
        to = np.searchsorted(under_at, unit, "right") - 1
        for t in np.unique(to):
            yield t, got[t] + unit[to == t] - under_at[t]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, number, n, first in batch[["shard", "number", "n", "first"]].itertuples(index=False):
                at = 0
                for t, k in of(number, first + np.arange(n)):
                    for turn in np.unique(k // blocks[t]) if len(k) else ():
                        place = k[k // blocks[t] == turn] % blocks[t]
                        yield pd.DataFrame({
                            "shard": shard, "slot": [f"{number}-{i}" for i in range(at, at + len(place))],
                            "number": t, "pass": turn, "block": permuted(place, int(blocks[t]), (seed, int(t), int(turn))),
                        })
                        at += len(place)

    return drawn.mapInPandas(run, "shard long, slot string, number long, pass long, block long")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = 5):
    """Of (row, doc_id, source, size): the sources, the parts of each block, and the slots of the mix.

    sources: source, number, source_size, target. parts: row, number, block, start
    (word of the row's text, from 0) and words. slots: see there.
    """
    spark = rows.sparkSession
    sources = stored(source_targets(rows, weights, share), "sources")
    known = sources.orderBy("number").toPandas()
    size, target = known["source_size"].to_numpy(np.int64), known["target"].to_numpy(float)
    blocks = -(-size // block)
    quota = np.minimum(np.rint(target / np.maximum(size, 1) * blocks).astype(np.int64), REPEAT * blocks)

    n_slices = max(1, rows.count() // SLICE)
    numbered = rows.join(
        sources.select(F.col("source").alias("s"), "number"), F.col("source").eqNullSafe(F.col("s")),
    ).select("row", "doc_id", "number", "size").where("size > 0")
    # Places follow from doc_ids alone, so another layout of the files gives the same mix; only a doc_id (or null) that is
    # there more often than a slice has rows is spread by its rows.
    often = stored(numbered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SLICE).select(F.col("doc_id").alias("often")), "often")
    numbered = numbered.join(often.withColumn("hot", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("often")), "left")
    numbered = numbered.withColumn("part", F.when(F.col("hot"), F.col("row"))).drop("often", "hot")
    slice_of = F.pmod(F.xxhash64("doc_id", "part"), F.lit(n_slices))
    placed = running_total(numbered, ["number"], slice_of, [F.col("doc_id"), F.col("size"), F.col("row")], "size", "at")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = placed.withColumn("block", F.explode(F.sequence(first, last))).select(
        "row", "number", "block",
        F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).alias("start"),
        (F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")) - F.greatest(F.col("block") * block, F.col("at"))).alias("words"),
    )
    drawn = stored(draws(spark, quota, seed), "draws") if quota.sum() else spark.createDataFrame([], "shard long, number long, n long")
    got = np.zeros(len(known), np.int64)
    for r in drawn.groupBy("number").agg(F.sum("n").alias("n")).collect():
        got[r["number"]] = r["n"]
    ordered = running_total(drawn, ["number"], F.floor(F.col("shard") / 1024), [F.col("shard")], "n", "first")
    # A few draws become very many slots: as many tasks as the slots ask for, not as the draws do.
    spread = ordered.repartition(max(1, -(-int(quota.sum()) // TASK_SLOTS)))
    return sources, parts, slots(spread, quota, got, blocks, seed)


def sized_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows with a key of their own and the number of words, written so that keys stay."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), *columns), "sized")


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes from the row, repeats counted)."""
    rows = sized_rows(docs)
    sources, parts, mix = plan(rows, **options)
    # Written: its size can't be guessed from the few draws it comes from, and a guess could make it a broadcast.
    times = stored(mix.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times")), "times")
    taken = parts.join(times, ["number", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # The sources go by a written table, so Spark knows how small they are.
    out = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, in the columns of ``docs``: per pass one row with the words that pass takes.

    A row taken whole keeps its text as it is; n_chars, if there, is that of the text returned.
    """
    columns = docs.columns
    rows = sized_rows(docs, *[F.col(c).alias(f"_{c}") for c in columns])
    _, parts, mix = plan(rows.select("row", "doc_id", "source", "size"), **options)
    used = stored(mix.select("number", "block", "pass"), "slots")
    taken = parts.join(used, ["number", "block"]).groupBy("row", "pass").agg(
        F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("words").cast("int").alias("words")))).alias("spans"),
        F.sum("words").alias("taken"),
    )
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("words"), s["start"] + 1, s["words"]))), " ")
    out = rows.join(taken, "row").withColumn("words", F.when(F.col("taken") < F.col("size"), words))
    out = out.withColumn("_text", F.when(F.col("taken") < F.col("size"), part).otherwise(F.col("_text")))
    if "n_chars" in columns:
        out = out.withColumn("_n_chars", F.length("_text").cast("long"))
    return out.select(*[F.col(f"_{c}").alias(c) for c in columns])


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sizes(spark.read.parquet(f"{folder}/documents.parquet"))
