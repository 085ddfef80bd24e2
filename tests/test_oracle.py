"""Every registered query beside its SQL, on the small tables; plans free of pairwise joins and Python rows."""

import pytest

from pressroute.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLE[name], BASE) is None


BARRED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "MapInPandas", "MapInArrow")


def _listed(store):
    found = store.executionsList().iterator()
    while found.hasNext():
        yield found.next()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_or_python_rows(spark, name):
    """In the query's own plan and in those of the jobs that it runs when called, such as writes and streams."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = max((e.executionId() for e in _listed(store)), default=-1)
    plans = [QUERIES[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans += [e.physicalPlanDescription() for e in _listed(store) if e.executionId() > before]
    for plan in plans:
        for word in BARRED:
            assert word not in plan, word
