"""Tables that go when nothing reads them any more, and lookups a part of the subjects at a time."""

import os

import pytest
from pyspark.sql import functions as F

from lectern import plans
from lectern.operators import layout
from lectern.plans import curriculum
from lectern.session import shared_root


def left(spark):
    return set(os.listdir(shared_root(spark)))


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(n, "A b c. D, e\nA x. A b" if n % 3 else "G h, g i\nG", ["en", "de", None][n % 3], "web", 13) for n in range(30)]
    docs = spark.createDataFrame([*rows, *rows[:4], (40, None, "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_lookups_leave_only_their_result(spark, documents):
    before = left(spark)
    out = plans.load()[0]["p14_lookups"](spark, documents)
    names = {x.split("-")[0] for x in left(spark) - before}
    assert names == {"lookups"} and out.count() > 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_parts_find_what_one_part_finds(spark, documents, monkeypatch):
    found = sorted(map(tuple, plans.load()[0]["p14_lookups"](spark, documents).collect()))
    monkeypatch.setattr(curriculum, "LOOKUP_PARTS", 1)
    assert found == sorted(map(tuple, plans.load()[0]["p14_lookups"](spark, documents).collect()))
    assert [r[1:] for r in found if r[0] == "en-3"] == [("T0", "g", "0.1.0.1.0.0.0", "G h?"), ("T1", "g", "1.1.0.0.0", "G?")]
    assert [r[1:] for r in found if r[0] == "de-1"] == [
        ("T0", "a", "0.1.0.0.0", "A b c?"), ("T0", "d", "0.1.1.1.0.0.0", "D?"), ("T1", "a", "1.1.0.0.0", "A x?")]


def test_scratch_deletes_its_tables_and_keeps_the_kept(spark):
    with layout.scratch(spark):
        before = left(spark)
        with layout.scratch(spark):
            kept = layout.written(spark.range(6).withColumn("part", (F.col("id") % 2).cast("int")), "kept", codec="zstd", by="part", keep=True)
            layout.written(spark.range(3), "gone")
            assert len(left(spark) - before) == 2
        assert {x.split("-")[0] for x in left(spark) - before} == {"kept"}
        assert sorted(map(tuple, kept.where("part = 1").collect())) == [(1, 1), (3, 1), (5, 1)]
    assert not left(spark) - before
    stays = layout.written(spark.range(3), "stays")
    assert stays.count() == 3 and layout._scratch == []


def test_a_setting_is_put_back_after_a_table_is_written(spark):
    assert spark.conf.get(layout.CLEANUP, None) == "false" or spark.conf.get(layout.CLEANUP, None) is None
    layout.written(spark.range(3).repartition(2), "once")
    was = spark.conf.get(layout.CLEANUP, None)
    spark.conf.set(layout.CLEANUP, "false")
    layout.written(spark.range(3).repartition(2), "twice")
    assert spark.conf.get(layout.CLEANUP) == "false"
    spark.conf.unset(layout.CLEANUP)
    assert spark.conf.get(layout.CLEANUP, None) == was
