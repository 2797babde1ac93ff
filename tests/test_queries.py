"""Every registered query against its SQL twin, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as contract
from check import connect, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got, want = df.toPandas(), db.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["nmf", "production_scores", "session_tensors", "boosted_multi_target", "oof_cv_loop", "ensemble_scores"])
def test_query_without_twin_runs(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["session_id", "blend_choc", "blend_beer", "blend_hair", "blend_rice"]
    assert df.count() > 0


def test_filters_reach_the_scan(spark):
    """Splits, purchases and returns are picked on stored columns."""
    for name, column in (("filter_returns", "l_quantity"), ("return_rows", "l_quantity"), ("customer_category_matrix", "o_orderdate")):
        plan = plan_of(contract.queries()[name](spark, FOLDER))
        assert any(column in line for line in re.findall(r"PushedFilters: \[(.*)", plan)), name
