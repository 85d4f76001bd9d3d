"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

from matchlake.plans import analytics, lookups, merges, more, ordered, relational, skewed, streams, telemetry  # noqa: F401
from matchlake.plans.registry import QUERIES, SQL
from tests.conftest import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert list(got.columns)
        return
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_has_one_shuffle_and_pruned_scan(spark):
    plan = _plan(QUERIES["flagship_moments"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(p_type)" in _plan(QUERIES["p1_p5_predicates"](spark, SF)) or "In(p_size" in _plan(QUERIES["p1_p5_predicates"](spark, SF))


def test_not_in_is_null_aware(spark):
    from matchlake.operators.joins import not_in

    some = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert not_in(some, "a", spark.createDataFrame([(2,)], "b int"), "b").count() == 1
    assert not_in(some, "a", spark.createDataFrame([(2,), (None,)], "b int"), "b").count() == 0
