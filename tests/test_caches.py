"""Caches over whole tables: pointer doubling for age, rounds over blocks for capacity and age together."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import capacity, jumps, ordered
from lectern.operators.layout import largest_so_far, written

SECOND = 1_000_000


def requests(n, seed, keys, shards=("a", "a", "b", None)):
    """Requests of a few shards without long pauses; times repeat."""
    rng = random.Random(seed)
    now, rows = 0, []
    for i in range(n):
        now += rng.choice([0, 1, 1, 2, 5]) * SECOND
        key = None if rng.random() < 0.02 else f"k{int(keys * rng.random() ** 2)}"
        rows.append((i, rng.choice(shards), key, now))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, shard string, key string, us long").repartition(4)


def walk(rows, room, ttl):
    """One request after another, as a cache in memory answers them."""
    caches, out = {}, {}
    for i, shard, key, us in sorted(rows, key=lambda r: (r[3], r[0])):
        held = caches.setdefault(shard, {})
        was = held.get(key)
        if was is not None and us - was <= ttl:
            out[i] = (True, False, None)
            continue
        held.pop(key, None)
        gone = None
        if len(held) >= room:
            gone = min(held, key=lambda k: (held[k], list(held).index(k)))
            del held[gone]
        held[key] = us
        out[i] = (False, was is not None, gone)
    return out


@pytest.mark.parametrize("block_rows", [7, 64, 1 << 16])
def test_jumps_match_a_walk(spark, block_rows):
    rows = requests(700, 3, 6)
    out = jumps.ttl_cached(frame(spark, rows), ["shard", "key"], "us", "id", 20 * SECOND, block_rows).collect()
    filled, expected = {}, {}
    for i, shard, key, us in sorted(rows, key=lambda r: (r[3], r[0])):
        expected[i] = (shard, key) in filled and us - filled[shard, key] <= 20 * SECOND
        if not expected[i]:
            filled[shard, key] = us
    assert {r["id"]: r["hit"] for r in out} == expected and len(out) == 700


def test_jumps_agree_with_the_scan_and_keep_columns(spark):
    rows = frame(spark, [(i, "s", "one", i * SECOND) for i in range(3000)]).withColumn("more", F.col("id") * 2)
    a = jumps.ttl_cached(rows, ["key"], "us", "id", 10 * SECOND, 100)
    b = ordered.ttl_cached(rows, "key", "us", "id", 10 * SECOND)
    assert set(a.columns) == set(b.columns)
    assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    # A request exactly one lifetime old still hits, so of each eleven one fills.
    assert a.where("NOT hit").count() == 3000 // 11 + 1


def test_one_key_with_all_rows_is_cut_into_equal_blocks(spark):
    rows = frame(spark, [(i, "s", "one", i) for i in range(5000)])
    numbered = written(jumps.number_rows(rows, ["key", "us", "id"]), "test")
    pointers = jumps.successors(numbered, ["key"], "us", 3)
    sizes = [r["n"] for r in pointers.groupBy(F.floor(F.col("number") / 500)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sizes == [500] * 10
    fills = jumps.on_paths(pointers, 500).where("fill").select("number").collect()
    assert sorted(r[0] for r in fills) == list(range(0, 5000, 4))


def test_jumps_of_nothing(spark):
    assert jumps.ttl_cached(frame(spark, []), ["key"], "us", "id").collect() == []


def test_largest_so_far(spark):
    rows = [(i, (i * 7) % 50 if i % 3 else None) for i in range(200)]
    found = largest_so_far(spark.createDataFrame(rows, "i long, v long").repartition(5), ["i"], "v", "top").orderBy("i").collect()
    top, expected = None, []
    for _, v in rows:
        top = v if top is None else max(top, v if v is not None else top)
        expected.append(top)
    assert [r["top"] for r in found] == expected


@pytest.mark.parametrize("room, ttl, block_rows, keys", [(1, 15, 40, 8), (5, 60, 40, 30), (5, 1000, 40, 30), (40, 60, 64, 30), (8, 30, 1 << 16, 20)])
def test_capacity_matches_a_walk(spark, room, ttl, block_rows, keys):
    rows = requests(900, room, keys)
    out = capacity.cached(frame(spark, rows), "shard", "key", "us", "id", room, ttl * SECOND, block_rows).collect()
    expected = walk(rows, room, ttl * SECOND)
    assert {r["id"]: (r["hit"], r["expired"], r["evicted"]) for r in out} == expected and len(out) == 900
    assert any(hit for hit, _, _ in expected.values())


def test_few_rounds_settle_a_long_run(spark):
    """One shard without a pause: a cache forgets the state it started from within a few blocks."""
    rows = frame(spark, requests(4000, 9, 60, ("a",))).withColumn("key", F.coalesce("key", F.lit("none")))
    numbered = written(capacity.number_rows(rows, ["us", "id"], "place"), "test")
    plain = numbered.select(F.floor(F.col("place") / 250).cast("long").alias("block"), "shard", "place", "key", "us")
    fills = jumps.ttl_cached(plain, ["shard", "key"], "us", "place", 100 * SECOND).where("NOT hit").select("place")
    states, rounds = capacity._settled(plain, capacity._guess(plain, fills, 20), 20, 100 * SECOND)
    assert states.count() == 16 and rounds < 8


def test_capacity_of_nothing_and_clashing_names(spark):
    assert capacity.cached(frame(spark, []), "shard", "key", "us", "id").collect() == []
    rows = frame(spark, [(1, None, None, 5), (2, None, None, 6)]).withColumns({"block": F.lit(7), "place": F.lit("x"), "state": F.lit(None).cast("string")})
    out = capacity.cached(rows, "shard", "key", "us", "id").orderBy("id").collect()
    assert [(r["hit"], r["block"], r["place"], r["state"]) for r in out] == [(False, 7, "x", None), (True, 7, "x", None)]
