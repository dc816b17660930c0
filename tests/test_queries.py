import os

import pytest
from oracle import DATA, connect, same

from twinline.plans import registry

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sql, name):
    same(registry.QUERIES[name](spark, DATA), registry.SQL[name], sql)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_prune_and_push_down(spark):
    plan = registry.QUERIES["a9_pruned_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(line)" in plan and "GreaterThan(line,20)" in plan and "text" not in plan.split("ReadSchema")[1]
    plan = registry.QUERIES["j5_cosine_pairs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
