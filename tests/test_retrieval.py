import numpy as np
from pyspark.sql import functions as F

from lectern import views
from lectern.functions import vectors
from lectern.operators import blocks, cache, layout, retrieval


def hits(df):
    return sorted((r["query_id"], r["collection"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_both_layouts_agree_with_brute_force(spark, folder):
    store, asked = views.vector_store(spark, folder), views.query_vectors(spark, folder)
    near = hits(retrieval.top_hits(asked, store))
    cut = hits(retrieval.top_hits(asked, store, probe_rows=6, item_rows=40))
    rows, queries = store.collect(), asked.collect()
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    brute = []
    for q in queries:
        scored = {}
        for r in rows:
            s = round(float(unit(q["query_embedding"]) @ unit(r["embedding"])), 12)
            scored.setdefault(r["collection"], []).append((-s, r["vec_id"]))
        for name, pairs in scored.items():
            brute += [(q["query_id"], name, v, round(-s, 9)) for s, v in sorted(pairs)[:2]]
    assert near == cut == sorted(brute)


def test_ties_go_to_the_smaller_id(spark):
    store = spark.createDataFrame([(i, "c", [1.0, 0.0]) for i in range(30)], "vec_id long, collection string, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, query_embedding array<float>")
    for limits in ({}, {"probe_rows": 0, "item_rows": 7}):
        limits = limits and limits | {"probe_rows": 1, "probe_bytes": 0}
        assert [h[2] for h in hits(retrieval.top_hits(asked, store, **limits))] == [0, 1]


def test_small_inputs_are_fetched_only_within_bounds(spark):
    df = spark.range(10)
    assert len(blocks.fetch_small(df, 10, 10_000)) == 10
    assert blocks.fetch_small(df, 9, 10_000) is None and blocks.fetch_small(df, 10, 5) is None


def test_budget_stops_at_first_overflow(spark):
    rows = [(1, p, "x" * n) for p, n in enumerate([150, 200, 100, 10], 1)]
    df = spark.createDataFrame(rows, "query_id long, place int, text string")
    assert [r["place"] for r in retrieval.fit_budget(df).orderBy("place").collect()] == [1, 2]


def test_full_budget_is_not_below_it(spark):
    df = spark.createDataFrame([(1, 1, "x" * 400)], "query_id long, place int, text string")
    assert retrieval.fit_budget(df).count() == 0 and retrieval.fit_budget(df, 401).count() == 1


def test_grade_bonus_and_primary_order(spark):
    rows = [(1, 1, "a", "src", 0.9, "t" * 20, 10, "grade 10 cells"), (1, 2, "b", "NEB notes", 0.6, "t" * 20, 9, "grade 10 cells"),
            (1, 3, "c", "src", 0.9, " short ", 9, "x")]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, collection string, source string, score double, text string, grade int, q string")
    out = retrieval.primary_first(retrieval.rank_hits(df, grade="grade", query_text="q")).orderBy("position").collect()
    assert [r["vec_id"] for r in out] == [2, 1]
    assert [round(r["final_score"], 6) for r in out] == [0.72, 0.88]


def test_hot_collection_is_cut_into_blocks(spark):
    store = spark.range(3000).select(
        F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("collection"),
        F.array((F.col("id") % 7).cast("float"), (F.col("id") % 11).cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    )
    asked = store.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    assert hits(retrieval.top_hits(asked, store)) == hits(retrieval.top_hits(asked, store, probe_rows=10, item_rows=100))


def test_zero_vectors_and_other_lengths_have_no_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [None, None, 1.0]


def test_encoder_blank_text_and_injection(spark):
    df = spark.createDataFrame([("",), (None,), ("a b",)], "t string")
    made = df.select(vectors.encoder_udf(lambda: (lambda texts: np.array([[3.0, 4.0]] * len(texts))), dim=2)(F.col("t"))).collect()
    assert [list(map(lambda x: round(x, 4), r[0])) for r in made] == [[0.0, 0.0], [0.0, 0.0], [0.6, 0.8]]


def test_semantic_cache_ignores_zero_and_expired(spark):
    schema = "{} long, subject string, grade string, us long, embedding array<float>"
    asked = spark.createDataFrame([(1, "s", "", 100, [1.0, 0.0]), (2, "s", "", 100, [0.0, 0.0]), (3, "t", "", 100, [1.0, 0.0])], schema.format("request_id"))
    held = spark.createDataFrame(
        [(7, "s", "", 40, [1.0, 0.01]), (8, "s", "", 99, [0.9, 0.1]), (9, "s", "", 100, [1.0, 0.0]), (10, "s", "", 99, [1.0])], schema.format("entry_id")
    )
    for limits in ({}, {"probe_rows": 1, "item_rows": 1}):
        rows = cache.semantic_hits(asked, held, 0.88, ttl=50, **limits).collect()
        assert [(r["request_id"], r["entry_id"]) for r in rows] == [(1, 8)]


def test_large_inputs_keep_their_partitions(spark, monkeypatch):
    df = spark.range(10).coalesce(1)
    assert layout.spread_small(df).rdd.getNumPartitions() > 1
    monkeypatch.setattr(layout, "estimated_bytes", lambda _: 1 << 50)
    assert layout.spread_small(df).rdd.getNumPartitions() == 1
