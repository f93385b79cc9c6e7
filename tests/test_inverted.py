"""The inverted file against a full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import inverted


def clustered(n=3000, groups=40, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim)), rng


def store_of(spark, x, collections=3):
    rows = [(i, f"c{i % collections}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, collection string, embedding array<float>")


def asked_of(spark, q, **columns):
    rows = [(1000 + i, [float(v) for v in row]) for i, row in enumerate(q)]
    return spark.createDataFrame(rows, "query_id long, query_embedding array<float>").withColumns(columns)


def unit(x):
    x = np.asarray(x, "float32").astype(float)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def brute(x, q, k):
    scores = np.round(unit(q) @ unit(x).T, 12)
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -row))[:k]] for row in scores]


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_and_share_of_rows_met(spark):
    x, rng = clustered()
    q = x[rng.integers(0, len(x), 60)] + 0.1 * rng.normal(size=(60, x.shape[1]))
    index = inverted.build(store_of(spark, x))
    assert index.rows.count() == len(x) and index.sizes.sum() == len(x)
    asked = asked_of(spark, q)
    got = found(inverted.top_hits(asked, index, 10))
    recall = np.mean([len(set(got[1000 + i]) & set(best)) / 10 for i, best in enumerate(brute(x, q, 10))])
    assert recall >= 0.95 and inverted.share_met(asked, index) < 0.2


@pytest.mark.parametrize("limits", [{}, {"probe_rows": 5, "item_rows": 37}])
def test_exact_equals_a_full_search(spark, limits):
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(500, 8)), rng.normal(size=(30, 8))
    x[400:410] = x[3]  # equal rows, ties
    x[420], q[5] = 0, 0
    index = inverted.build(store_of(spark, x), cells=25)
    got = found(inverted.top_hits(asked_of(spark, q), index, 7, probes=1, exact=True, **limits))
    assert [got[1000 + i] for i in range(len(q))] == brute(x, q, 7)


def test_the_bound_closes_cells(spark):
    x, rng = clustered(800, 8, 8)
    index = inverted.build(store_of(spark, x), cells=16)
    asked = asked_of(spark, x[:20], edge=F.lit(0.95), met=F.lit(0))
    looked = inverted._asked(asked, index, None).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()
    # Every cell with a row at least that near is looked into, and most others are not.
    cell = {r["vec_id"]: r["cell"] for r in index.rows.select("vec_id", "cell").collect()}
    needed = [{cell[i] for i in np.flatnonzero(row >= 0.95)} for row in unit(x[:20]) @ unit(x).T]
    pairs = {(r["query_id"], r["cell"]) for r in inverted._asked(asked, index, None).select("query_id", "cell").collect()}
    assert all((1000 + i, c) in pairs for i, cells in enumerate(needed) for c in cells)
    assert sum(r["n"] for r in looked) < 0.6 * 20 * (index.sizes > 0).sum()


def test_collections_are_ranked_apart(spark):
    x, rng = clustered(600, 10, 8)
    index = inverted.build(store_of(spark, x))
    asked = asked_of(spark, x[:9], collection=F.explode(F.array(F.lit("c0"), F.lit("c2"), F.lit("none"))))
    hits = inverted.top_hits(asked, index, 3, exact=True, by="collection").collect()
    got = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        got.setdefault((r["query_id"], r["collection"]), []).append(r["vec_id"])
    for c in (0, 2):
        own = np.arange(c, len(x), 3)
        for i, best in enumerate(brute(x[own], x[:9], 3)):
            assert got[1000 + i, f"c{c}"] == [int(own[b]) for b in best]
    assert len(got) == 18


def test_hot_cell_and_small_stores(spark):
    same = np.ones((300, 4))
    index = inverted.build(store_of(spark, same), cells=5)
    got = found(inverted.top_hits(asked_of(spark, same[:2]), index, 4, item_rows=50))
    assert got == {1000: [0, 1, 2, 3], 1001: [0, 1, 2, 3]}
    empty = inverted.build(store_of(spark, same[:0]))
    assert inverted.top_hits(asked_of(spark, same[:2]), empty, 4, exact=True).collect() == []
    one = inverted.build(store_of(spark, same[:1]))
    assert found(inverted.top_hits(asked_of(spark, same[:1]), one, 4, exact=True)) == {1000: [0]}
    assert inverted.top_hits(asked_of(spark, same[:0]), one, 4, exact=True).collect() == []
