"""Streams over tables that lie in one file and over tables that are a folder of files."""

import pytest

from lectern import plans
from lectern.session import shared_folder
from lectern.streaming import jobs

QUERIES = plans.load()[0]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def parted(spark, folder):
    """The same tables, each a folder of three files."""
    path = shared_folder(spark, "parted")
    for name in ("conversations", "documents", "embeddings", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["conversations", "events"])
def test_a_folder_streams_all_its_files(spark, folder, parted, name):
    for where in (folder, parted):
        seen = []
        jobs.start(jobs.read_table_stream(spark, where, name), lambda batch, _: seen.append(batch.count()), "append").awaitTermination()
        assert sum(seen) == spark.read.parquet(f"{folder}/{name}.parquet").count()


@pytest.mark.parametrize("query", ["r5_k7_k8_feedback", "r6_incremental_ingest", "r7_semantic_stream"])
def test_queries_on_folders(spark, folder, parted, query):
    found = rows_of(QUERIES[query](spark, parted))
    assert found and found == rows_of(QUERIES[query](spark, folder))


@pytest.mark.parametrize("query, scan", [("r2_ttl_cache_stream", "ttl_cache"), ("r3_rate_limit_stream", "rate_limiter")])
def test_a_keyed_scan_gets_only_what_it_needs(spark, folder, monkeypatch, query, scan):
    """The texts of a key's events do not go through Python."""
    given, scans = [], getattr(jobs, scan)
    monkeypatch.setattr(jobs, scan, lambda stream, *rest: given.append(stream.columns) or scans(stream, *rest))
    monkeypatch.setattr(jobs, "OUT_ROWS", 7)
    assert QUERIES[query](spark, folder).count() == spark.read.parquet(f"{folder}/events.parquet").count()
    assert given[0] == ["event_id", "event_type" if scan == "ttl_cache" else "user_id", "us", "ts"]
