"""Points in intervals against brute force; the plan holds no nested loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressroute.operators.intervals import aggregate_in_intervals, covering_nodes

T0 = dt.datetime(2024, 3, 1)


def brute(intervals, points):
    out = {}
    for key, a, b in intervals:
        for at, v in points:
            if a is not None and b is not None and at is not None and a <= at <= b:
                low, high, n = out.get(key, (v, v, 0))
                out[key] = (min(low, v), max(high, v), n + 1)
    return sorted((k, *v) for k, v in out.items())


def found(spark, intervals, points):
    i = spark.createDataFrame(intervals, "run int, a timestamp_ntz, b timestamp_ntz")
    p = spark.createDataFrame(points, "at timestamp_ntz, v int").withColumn("one", F.lit(1))
    return aggregate_in_intervals(i, ["run"], "a", "b", p, "at", {"low": (F.min, "v"), "high": (F.max, "v"), "n": (F.sum, "one")})


@pytest.mark.parametrize("scale", [1, 50, 4_000_000])
def test_overlapping_runs_equal_brute_force(spark, scale):
    """From runs inside one second to runs of months, half of the points at one instant."""
    rng = random.Random(scale)

    def moment():
        return T0 + dt.timedelta(seconds=rng.random() * scale)

    points = [(moment(), rng.randrange(1000)) for _ in range(300)]
    points += [(points[0][0], rng.randrange(1000)) for _ in range(300)] + [(None, 5)]
    intervals = [(k, *sorted((moment(), moment()))) for k in range(80)]
    intervals += [(100, points[0][0], points[0][0]), (101, None, moment()), (102, moment(), None), (103, T0 + dt.timedelta(days=400), T0),
                  (104, *(2 * [points[1][0].replace(microsecond=0)]))]
    assert sorted(map(tuple, found(spark, intervals, points).collect())) == brute(intervals, points)


def test_nodes_cover_each_leaf_once(spark):
    spans = [(a, b) for a in range(-9, 20, 3) for b in range(a - 2, a + 40, 7)]
    rows = spark.createDataFrame(spans, "a long, b long").withColumn("nodes", covering_nodes(F.col("a"), F.col("b"), 6)).collect()
    for r in rows:
        leaves = [leaf for n in r.nodes for leaf in range(n.node << n.level, n.node + 1 << n.level)]
        assert sorted(leaves) == list(range(r.a, r.b + 1)) and len(r.nodes) <= 12


def test_no_nested_loop_and_no_product(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found(spark, [(1, T0, T0 + dt.timedelta(days=3))], [(T0, 1)])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_no_points_and_no_intervals(spark):
    assert found(spark, [], [(T0, 1)]).count() == 0
    assert found(spark, [(1, T0, T0)], []).count() == 0
