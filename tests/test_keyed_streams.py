"""Keyed streams whose rows come late and twice, with a restart in between, against the table form."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import ordered
from lectern.streaming import jobs, keyed

SECOND = 1_000_000
START = 1_700_000_000 * SECOND


def arrivals(seed, parts=4, n=240):
    """Parts of requests in order of arrival: up to a minute out of order, some twice, some again in the next part."""
    rng = random.Random(seed)
    now, rows = START, []
    for i in range(n):
        now += rng.choice([0, 1, 2, 9]) * SECOND
        rows.append((i, rng.choice(["a", "a", "b"]), now))
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randint(0, 55) * SECOND)
    cut = [shuffled[k * n // parts: (k + 1) * n // parts] for k in range(parts)]
    return rows, [part + rng.sample(part, 5) + (rng.sample(cut[k - 1][-10:], 3) if k else []) for k, part in enumerate(cut)]


def deliver(spark, folder, number, rows):
    frame = spark.createDataFrame(rows, "id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    frame.coalesce(1).write.parquet(f"{folder}/in/part={number}")


def answers(spark, folder, make):
    source = spark.readStream.schema("id long, key string, us long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    keyed.with_rocksdb(spark, lambda: jobs.append_to(make(source), f"{folder}/out", f"{folder}/checkpoint").awaitTermination())


@pytest.mark.parametrize("seed, kind", [(1, "accepted"), (2, "hit")])
def test_late_and_repeated_rows_with_a_restart(spark, tmp_path, seed, kind):
    rows, parts = arrivals(seed)
    folder = str(tmp_path)
    end = [(10_000 + k, key, rows[-1][2] + 3600 * SECOND) for k, key in enumerate("ab")]

    def make(source):
        if kind == "accepted":
            return keyed.rate_limiter(source, "key", "us", "id", 30 * SECOND, 3, "2 minutes")
        return keyed.ttl_cache(source, "key", "us", "id", 20 * SECOND, "2 minutes")

    for number, part in enumerate(parts[:2]):
        deliver(spark, folder, number, part)
    answers(spark, folder, make)
    for number, part in enumerate(parts[2:], 2):
        deliver(spark, folder, number, part)
    deliver(spark, folder, 9, end)
    answers(spark, folder, make)
    # What the watermark has not passed is still waiting: the two rows that moved it.
    got = {r["id"]: r[kind] for r in spark.read.parquet(f"{folder}/out").where("id < 10000").collect()}
    table = spark.createDataFrame(rows, "id long, key string, us long")
    if kind == "accepted":
        expected = ordered.rate_limited(table, "key", "us", "id", 30 * SECOND, 3)
    else:
        expected = ordered.ttl_cached(table, "key", "us", "id", 20 * SECOND)
    assert got == {r["id"]: r[kind] for r in expected.collect()}
    assert spark.read.parquet(f"{folder}/out").where("id < 10000").count() == len(rows)


def test_the_state_store_is_asked_for(spark):
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("id"), F.lit("a").alias("key"), F.col("timestamp").alias("ts"), F.lit(1).cast("long").alias("us"))
    with pytest.raises(ValueError, match="RocksDB"):
        keyed.rate_limiter(stream, "key", "us", "id")
