"""The answer cache as tables: exact and semantic look-up, size, eviction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import blocks
from lectern.operators.retrieval import TIE_PLACES, _unit
from lectern.sinks import tables

TTL = 3_600_000_000
THRESHOLD = 0.92
KEYS = ["subject", "grade", "_n", "_b"]


def exact_hits(requests: DataFrame, fills: DataFrame, ttl: int = TTL) -> DataFrame:
    """The value of the last fill of the same key, made before the request and not expired.

    ``requests``: key, us and more. ``fills``: key, us, value. Both lie in time
    buckets of one TTL, a fill also in the next, so a window holds two TTLs of
    one key and never the key's whole past. Adds ``value``, null on a miss.
    """
    bucket = F.floor(F.col("us") / ttl)
    names = requests.columns
    asked = requests.select(F.struct(*names).alias("r"), "key", "us", bucket.alias("b"), F.lit(None).cast(fills.schema["value"].dataType).alias("v"), F.lit(0).alias("kind"))
    filled = fills.select(
        F.lit(None).cast(asked.schema["r"].dataType).alias("r"), "key", "us", F.explode(F.array(bucket, bucket + 1)).alias("b"),
        F.col("value").alias("v"), F.lit(1).alias("kind"),
    )
    # At equal times requests come first: an entry answers what is asked after it.
    past = Window.partitionBy("key", "b").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 1, F.struct("us", "v")), ignorenulls=True).over(past)
    seen = asked.unionByName(filled).withColumn("last", last).where("kind = 0")
    return seen.select("r.*", F.when(F.col("us") - F.col("last.us") <= ttl, F.col("last.v")).alias("value"))


def semantic_hits(
    requests: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, ttl: int = TTL, **limits
) -> DataFrame:
    """The most similar live entry of the same subject and grade, if similar enough.

    ``requests``: request_id, subject, grade, us, embedding. ``entries``: entry_id,
    subject, grade, us, embedding. Zero vectors and other lengths never match.
    Ties go to the smaller id.
    """

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        groups = {k: g for k, g in q.groupby(KEYS, sort=False)}
        for key, part in c.groupby(KEYS, sort=False):
            asked = groups.get(key)
            if asked is None:
                continue
            part = part.sort_values("entry_id", kind="stable")
            now, then = asked["us"].to_numpy(), part["us"].to_numpy()
            ids, q, e = part["entry_id"].to_numpy(), _unit(asked["embedding"]), _unit(part["embedding"])
            entry, top = ids[np.zeros(len(asked), int)], np.full(len(asked), -np.inf)
            for down, across in blocks.tiles(len(asked), len(part)):
                age = now[down, None] - then[None, across]
                values = np.where((age > 0) & (age <= ttl), np.round(q[down] @ e[across].T, TIE_PLACES), -np.inf)
                best = values.argmax(axis=1)
                score = values[np.arange(len(best)), best]
                # Entries come by id: of equal ones the first tile's stays.
                more = score > top[down]
                top[down][more], entry[down][more] = score[more], ids[across][best[more]]
            parts.append(pd.DataFrame({"request_id": asked["request_id"].to_numpy(), "entry_id": entry, "score": top}))
        found = pd.concat(parts) if parts else pd.DataFrame(columns=["request_id", "entry_id", "score"])
        return trim(found[found["score"] >= threshold])

    def trim(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["score", "entry_id"], ascending=[False, True]).groupby("request_id", sort=False).head(1)

    def usable(df: DataFrame, buckets: Column) -> DataFrame:
        sized = df.withColumn("_n", F.size("embedding")).where(F.exists("embedding", lambda x: x != 0))
        return sized.withColumn("_b", buckets)

    # An entry lives for one TTL: only requests of its time bucket and the next can meet it.
    bucket = F.floor(F.col("us") / ttl)

    partial = blocks.match_blocks(
        usable(requests.select("request_id", "subject", "grade", "us", "embedding"), bucket),
        usable(entries.select("entry_id", "subject", "grade", "us", "embedding"), F.explode(F.array(bucket, bucket + 1))),
        score, "request_id long, entry_id long, score double", keys=KEYS, trim=trim, grown=blocks.BLOCK_ROWS, **limits,
    )
    first = F.min_by(F.struct("entry_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("entry_id")))
    return partial.groupBy("request_id").agg(first.alias("b")).select("request_id", "b.*")


def misses(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """What still has to be answered."""
    return requests.join(hits.select("request_id"), "request_id", "left_anti")


def live_size(fills: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Keys whose last fill has not expired at ``now``."""
    last = fills.groupBy("key").agg(F.max("us").alias("us"))
    return last.where(now - F.col("us") <= ttl).agg(F.count(F.lit(1)).alias("size"))


def newest(fills: DataFrame, capacity: int, keys: list[str] = ("key",), order: list[str] = ("us",)) -> DataFrame:
    """W5 + R4: the keys that stay in a cache of this capacity, by time of their last fill."""
    last = tables.latest(fills, list(keys), list(order))
    return last.orderBy(*[F.desc(c) for c in order], *keys).limit(capacity)


def last_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """W4 + S10: the last ``n`` rows, in order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
