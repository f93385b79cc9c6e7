"""The store by collection: listing, pruning, replacing."""

from pyspark.sql import functions as F

from lectern.operators import store
from lectern.operators.layout import written


def rows_of(spark, names, n=30):
    return spark.range(n).select(
        F.col("id").alias("vec_id"), F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("id") % len(names) + 1).cast("int")).alias("collection"),
        F.concat(F.lit("text "), "id").alias("text"),
    )


def test_listing_and_reading(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert store.collections(spark, path).collect() == []
    names = ["neb_en_grade_8", "a/b=c d", "10", None]
    store.write_store(rows_of(spark, names), path)
    assert {r[0] for r in store.collections(spark, path).collect()} == set(names)
    got = sorted(tuple(r) for r in store.read_store(spark, path).select("vec_id", "text").collect())
    assert got == [(i, f"text {i}") for i in range(30)]
    assert {r["vec_id"] for r in store.get_collection(spark, path, "a/b=c d").collect()} == set(range(1, 30, 4))
    assert {r["vec_id"] for r in store.get_collection(spark, path, "10").collect()} == set(range(2, 30, 4))


def test_names_that_look_like_numbers(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.write_store(rows_of(spark, ["007", "7"], 10), path)
    assert store.read_store(spark, path).groupBy("collection").count().orderBy("collection").collect() == [("007", 5), ("7", 5)]


def test_a_rewrite_replaces_only_its_collections(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.write_store(rows_of(spark, ["x", "y"], 10), path)
    store.write_store(rows_of(spark, ["y"], 3), path)
    assert store.read_store(spark, path).groupBy("collection").count().orderBy("collection").collect() == [("x", 5), ("y", 3)]


def test_large_collections_are_spread(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.write_store(rows_of(spark, ["x", "x", "x", "y"], 4000), path, file_rows=1000)
    assert len(list((tmp_path / "store" / "collection=x").glob("*.parquet"))) > 1
    assert len(list((tmp_path / "store" / "collection=y").glob("*.parquet"))) == 1


def test_selection_prunes_folders(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.write_store(rows_of(spark, [f"c{i}" for i in range(10)], 500), path)
    held = store.read_store(spark, path)
    asked = written(spark.createDataFrame([("c3",), ("c7",), ("c3",), ("none",), (None,)], "collection string"), "asked")
    found = store.selected_rows(held, asked)
    assert {r["collection"] for r in found.collect()} == {"c3", "c7"} and found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "dynamicpruning" in line.lower())
    assert "collection" in scan
