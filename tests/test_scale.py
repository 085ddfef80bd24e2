"""Plans that have to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from pressroute.operators import joins, ordered
from pressroute.plans import schedules
from pressroute.queries import QUERIES
from pressroute.sources import tables
from pressroute.sources.frames import Frames

BASE = "/root/testdata/sf0.001"


@pytest.fixture()
def shuffled(spark):
    """Broadcast joins off, as when both sides are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_shuffles_the_rows_once(shuffled):
    """Window and join share one exchange; the other exchanges carry counts only."""
    events = Frames(shuffled, BASE).table("events")
    text = plan(ordered.numbered(events, ["user_id"], ["ts", "event_id"], F.to_date("ts")))
    left = text[text.index("SortMergeJoin"):]
    rows_side = left.split("\n      +- Sort")[0]
    assert rows_side.count("Exchange") == 1 and "PythonUDF" not in text


def test_schedule_join_is_an_equi_join(shuffled):
    t = Frames(shuffled, BASE)
    text = plan(schedules.net_by_manifest(t.draw_lines, t.publications, t.assignments))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert len(re.findall("SortMergeJoin", text)) == 2


def test_scan_reads_only_what_is_needed(spark):
    text = plan(QUERIES["between_filter"](spark, BASE))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_not_in_does_not_broadcast(shuffled):
    left, right = shuffled.range(100).toDF("a"), shuffled.range(50).toDF("b")
    assert "BroadcastExchange" not in plan(joins.null_aware_anti(left, right, "a", "b"))


def test_bucketed_tables_join_without_a_shuffle(shuffled):
    t = Frames(shuffled, BASE)
    keys = ["account_id", "publication_id"]
    tables.write_bucketed(t.draw_lines, "bucketed_draws", keys, 4)
    tables.write_bucketed(t.account_pubs, "bucketed_pairs", keys, 4)
    joined = tables.scan(shuffled, "bucketed_draws").join(tables.scan(shuffled, "bucketed_pairs"), keys)
    assert "Exchange" not in plan(joined)
    assert joined.count() == t.draw_lines.count()


def test_pivot_columns_are_the_only_thing_collected():
    """Library code collects bounded metadata in three places, each behind a limit or an aggregate."""
    import pathlib
    import pressroute
    hits = []
    top = pathlib.Path(pressroute.__file__).parent
    for path in (p for p in top.rglob("*.py") if "llm" not in p.relative_to(top).parts):
        hits += [path.name for line in path.read_text().splitlines() if re.search(r"\.(collect|toPandas|first)\(\)", line)]
    assert sorted(hits) == ["aggregates.py", "audits.py", "ordered.py"]


def test_hot_key_is_split_beside_an_aggregate(shuffled):
    """One key holds a third of the rows; the join with its group's total still spreads them."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: shuffled.conf.get(k) for k in settings}
    for k, v in settings.items():
        shuffled.conf.set(k, v)
    try:
        rows = shuffled.range(0, 400000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v"),
            F.md5(F.col("id").cast("string")).alias("text"))
        out = ordered.align_to_group(rows, ["k"], "v", "max")
        assert out.count() == 400000
        final = out.select(F.sum("v").alias("s"))
        assert final.collect()[0].s > 0
        assert "skew=true" in final._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            shuffled.conf.set(k, v)
