"""Scores in tiles, and both sides of a match from one table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks, cache, inverted, retrieval


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("seed", range(12))
def test_tiles_find_what_the_whole_matrix_holds(monkeypatch, metric, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(blocks, "TILE_ROWS", int(rng.integers(1, 20)))
    monkeypatch.setattr(blocks, "TILE_COLUMNS", int(rng.integers(1, 40)))
    n, m, d, k = (int(rng.integers(1, top)) for top in (40, 90, 9, 6))
    q, c = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    if seed % 2:  # many ties, zero vectors
        q, c = rng.integers(-2, 3, (n, d)).astype(float), rng.integers(-2, 3, (m, d)).astype(float)
    read, similarity = retrieval.METRICS[metric]
    q, c, ids = read(pd.Series(list(q))), read(pd.Series(list(c))), rng.permutation(m)
    whole = np.round(similarity(q, c), retrieval.TIE_PLACES)
    wanted = [(i, int(j)) for i in range(n) for j in np.lexsort((ids, -whole[i]))[:k]]
    rows, cols, values = retrieval.best_per_group(q, c, ids, k, similarity)
    assert list(zip(rows.tolist(), cols.tolist())) == wanted
    assert np.allclose(values, whole[rows, cols], rtol=0, atol=2e-12)


def stamped(spark, n=120):
    rng = np.random.default_rng(5)
    rows = [(i, "s", "", i * 10, [float(x) for x in rng.normal(size=4)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, subject string, grade string, us long, embedding array<float>")


def test_one_table_asks_itself_in_blocks(spark, monkeypatch):
    rows = stamped(spark)
    asked, held = rows.withColumnRenamed("vec_id", "request_id"), rows.withColumnRenamed("vec_id", "entry_id")
    near = sorted(map(tuple, cache.semantic_hits(asked, held, 0.3, ttl=400).collect()))
    monkeypatch.setattr(blocks, "TILE_ROWS", 7)
    monkeypatch.setattr(blocks, "TILE_COLUMNS", 5)
    assert near == sorted(map(tuple, cache.semantic_hits(asked, held, 0.3, ttl=400, probe_rows=10, item_rows=10).collect()))


def test_a_block_grows_with_its_key(spark):
    rows = spark.range(10_000).select((F.col("id") % 2).alias("key"))
    counted = lambda *size: {r["n"] for r in blocks._block_counts(rows, ["key"], *size, "n").collect()}
    assert counted(100, 0) == {50} and counted(100, blocks.BLOCK_ROWS) == {8} and counted(100, 200) == {25}
    assert counted(6000, blocks.BLOCK_ROWS) == {1}


def test_pairs_of_question_and_cell_come_in_bounded_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    index = inverted.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = spark.createDataFrame(rows[:60], "query_id long, query_embedding array<float>")
    whole = sorted(map(tuple, inverted._asked(asked, index, 3).select("query_id", "cell").collect()))
    monkeypatch.setattr(inverted, "ASKED", 100)
    assert whole == sorted(map(tuple, inverted._asked(asked, index, 3).select("query_id", "cell").collect()))


def test_selected_collections_meet_their_own_questions_alone(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, f"c{i % 5}", [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    store = spark.createDataFrame(rows, "vec_id long, collection string, embedding array<float>")
    names = [["c0"], ["c1", "c3", "c1"], ["c9"], [], ["c4", "c0"]]
    asked = spark.createDataFrame([(i, v, names[i % 5]) for i, _, v in rows[:40]], "query_id long, query_embedding array<float>, collections array<string>")
    near = sorted(map(tuple, retrieval.top_hits(asked, store, selected=True).collect()))
    assert {(q, c) for q, c, *_ in near} == {(i, c) for i in range(40) for c in names[i % 5] if c != "c9"}
    keyed, cogroup = [], blocks.cogroup_blocks
    monkeypatch.setattr(blocks, "cogroup_blocks", lambda *given: keyed.append(given[4]) or cogroup(*given))
    assert near == sorted(map(tuple, retrieval.top_hits(asked, store, selected=True, probe_rows=3, item_rows=9).collect()))
    assert keyed == [["collection"]]
