"""Every registered query against its SQL check, on whole tables."""

import pytest

import __spark_entry__ as entry
import check
from lectern import plans

QUERIES, ORACLES = plans.load()


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name in ORACLES:
        problem, _ = check.difference(df, ORACLES[name], folder)
        assert problem is None
    else:
        assert df.collect() is not None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
