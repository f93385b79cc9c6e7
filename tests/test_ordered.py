import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import cache, ordered
from lectern.streaming import jobs

SECOND = 1_000_000


def requests(n=600, seed=1):
    rng = random.Random(seed)
    rows, now = [], {"hot": 0, "a": 5, "b": 9}
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", "b"])
        now[key] += int(rng.choice([0.5, 1, 4, 20, 61, 300]) * SECOND)
        rows.append((i, key, now[key]))
    return rows


def limiter(rows, span, limit):
    kept, out = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [x for x in kept.get(key, []) if t - x < span]
        out[i] = len(live) < limit
        kept[key] = live + [t] if out[i] else live
    return out


def ttl(rows, span):
    filled, out = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = key in filled and t - filled[key] <= span
        if not out[i]:
            filled[key] = t
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, us long")


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit_matches_loop(spark, seed):
    rows = requests(seed=seed)
    out = ordered.rate_limited(frame(spark, rows), "key", "us", "id", 60 * SECOND, 3).collect()
    assert {r["id"]: r["accepted"] for r in out} == limiter(rows, 60 * SECOND, 3)


def test_eleventh_request_is_rejected_and_forgotten(spark):
    rows = [(i, "u", i * SECOND) for i in range(11)] + [(11, "u", 60 * SECOND)]
    out = ordered.rate_limited(frame(spark, rows), "key", "us", "id").orderBy("id").collect()
    assert [r["accepted"] for r in out] == [True] * 10 + [False, True]


@pytest.mark.parametrize("seed", [3, 4])
def test_ttl_matches_loop(spark, seed):
    rows = requests(seed=seed)
    out = ordered.ttl_cached(frame(spark, rows), "key", "us", "id", 30 * SECOND).collect()
    assert {r["id"]: r["hit"] for r in out} == ttl(rows, 30 * SECOND)


def test_entry_is_live_at_exactly_its_ttl(spark):
    rows = [(0, "u", 0), (1, "u", 3600 * SECOND), (2, "u", 3600 * SECOND + 1)]
    out = ordered.ttl_cached(frame(spark, rows), "key", "us", "id").orderBy("id").collect()
    assert [r["hit"] for r in out] == [False, True, False]


def test_trailing_count_matches_loop(spark):
    rows = requests()
    span = 60 * SECOND
    out = ordered.trailing_count(frame(spark, rows), ["key"], "us", span).collect()
    assert len(out) == len(rows)
    assert {r["id"]: r["recent"] for r in out} == {
        i: sum(k == key and 0 <= t - u < span for _, k, u in rows) for i, key, t in rows
    }


def test_runs_split_at_pauses_only(spark):
    rows = [(i, "k", t * SECOND) for i, t in enumerate([0, 59, 118, 178, 5000, 5010, 100_000])]
    out = ordered.with_runs(frame(spark, rows), ["key"], "us", 60 * SECOND).orderBy("id").collect()
    assert [r["run"] // SECOND for r in out] == [0, 0, 0, 178, 5000, 5000, 100_000]


def test_long_run_crosses_buckets(spark):
    rows = [(i, "k", i * 50 * SECOND) for i in range(500)]
    out = ordered.with_runs(frame(spark, rows), ["key"], "us", 60 * SECOND)
    assert out.select("run").distinct().count() == 1


def test_exact_cache_matches_loop(spark):
    rows, fills = requests(seed=7), requests(200, seed=8)
    span = 120 * SECOND
    out = cache.exact_hits(frame(spark, rows), frame(spark, fills).withColumn("value", F.col("id")).drop("id"), span).collect()
    expected = {}
    for i, key, t in rows:
        past = [(u, v) for v, k, u in fills if k == key and u < t]
        top = max(past)[0] if past else None
        expected[i] = {v for u, v in past if u == top} if past and t - top <= span else {None}
    assert all(r["value"] in expected[r["id"]] for r in out) and len(out) == len(rows)


def _stream(spark, tmp_path, rows, parts):
    """Rows arrive in time order, one file and one micro-batch at a time."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    step = len(rows) // parts + 1
    path = str(tmp_path / "in")
    for n in range(parts):
        part = frame(spark, rows[n * step : (n + 1) * step]).withColumn("ts", F.timestamp_micros("us"))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("kind", ["limit", "ttl"])
def test_stream_equals_table_over_several_batches(spark, tmp_path, kind):
    rows = requests(300, seed=11)
    stream = _stream(spark, tmp_path, rows, 3)
    if kind == "limit":
        out, name, expected = jobs.rate_limiter(stream, "key", "us", "id", 60 * SECOND, 3), "accepted", limiter(rows, 60 * SECOND, 3)
    else:
        out, name, expected = jobs.ttl_cache(stream, "key", "us", "id", 30 * SECOND), "hit", ttl(rows, 30 * SECOND)
    jobs.append_to(out.select("id", name), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r[name] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected


def test_newest_and_last_rows(spark):
    fills = frame(spark, [(1, "a", 5), (2, "b", 6), (3, "a", 9), (4, "c", 1)])
    assert [r["key"] for r in cache.newest(fills, 2).collect()] == ["a", "b"]
    assert [r["id"] for r in cache.last_rows(fills, 2, ["us"]).collect()] == [2, 3]
