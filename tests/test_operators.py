"""Operators on planted rows and against brute force on random rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressroute.functions.text import zero_pad
from pressroute.operators import aggregates as agg, joins, ordered, sets, sorting
from pressroute.plans import audits, logs, sales, schedules
from pressroute.queries import QUERIES
from pressroute.sources.frames import Frames

T0 = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than half of the rows; some keys are null; times repeat."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        data.append((i, key, T0 + dt.timedelta(minutes=rng.randrange(0, 6000)), rng.choice(["s", "e"])))
    return data, spark.createDataFrame(data, "id long, k string, ts timestamp_ntz, kind string").repartition(7)


def by_key(data):
    groups = {}
    for r in data:
        groups.setdefault(r[1], []).append(r)
    return {k: sorted(g, key=lambda r: (r[2], r[0])) for k, g in groups.items()}


def test_numbered_equals_plain_window(skewed):
    data, df = skewed
    got = {r.id: r.rn for r in ordered.numbered(df, ["k"], ["ts", "id"], F.to_date("ts")).collect()}
    assert got == {r[0]: i + 1 for g in by_key(data).values() for i, r in enumerate(g)}


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_global_number_by_ranges(skewed, parts):
    data, df = skewed
    got = {r.id: r.rn for r in ordered.numbered(df, [], ["ts", "id"], ordered.ranges(df, "ts", parts)).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[0])))}


def test_previous_equals_lag(skewed):
    data, df = skewed
    got = {r.id: r.prev for r in ordered.previous(df, ["k"], ["ts", "id"], "ts", F.date_trunc("hour", "ts")).collect()}
    want = {}
    for g in by_key(data).values():
        for before, r in zip([None, *g], g):
            want[r[0]] = before and before[2]
    assert got == want


def test_next_event_is_strictly_later(skewed):
    data, df = skewed
    out = ordered.next_event_after(df.where("kind = 's'").select("k", "id", "ts"), df.where("kind = 'e'"), ["k"], "ts")
    got = {r.id: r.next_ts for r in out.collect()}
    ends = {}
    for r in data:
        if r[3] == "e":
            ends.setdefault(r[1], []).append(r[2])
    want = {r[0]: min((e for e in ends.get(r[1], []) if e > r[2]), default=None) for r in data if r[3] == "s"}
    assert got == want


def test_pair_by_rank_shifts_when_an_end_is_lost(spark):
    log = spark.createDataFrame([(1, "g", T0, "start"), (2, "g", T0 + dt.timedelta(hours=1), "start"),
                                 (3, "g", T0 + dt.timedelta(hours=2), "end")], "log_id int, group_id string, logged_at timestamp_ntz, message string")
    runs = logs.run_durations(log, "start%", "end%", ["group_id"]).collect()
    assert [(r.run, r.duration) for r in runs] == [(1, "2h 00m 00s")]
    summary = logs.process_summary(log, {"p": ("start%", "end%")}, ["group_id"])
    assert summary.where("stopped is not null").count() == 2


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([(1, "x", T0), (2, "x", T0), (3, "x", T0 - dt.timedelta(1)), (4, "y", T0)], "id int, k string, ts timestamp_ntz")
    assert [r.id for r in ordered.latest_with_ties(df, ["k"], "ts").orderBy("id").collect()] == [1, 2, 4]


def test_weekly_history_stops_at_a_missing_week(spark):
    day = dt.date(2024, 3, 3)
    weeks = [0, 1, 2, 4, 5]
    df = spark.createDataFrame([(1, day - dt.timedelta(7 * w), 1, 100 + w) for w in weeks], "k int, d date, wd int, net int")
    row = ordered.weekly_history(df, ["k"], "d", "wd", "net").where(F.col("d") == F.lit(day)).first()
    assert [row[f"net_{i}"] for i in range(1, 8)] == [101, 102, None, None, None, None, None]


def test_version_diff_needs_the_version_before(spark):
    rows = [("d", 1, 5), ("d", 2, 9), ("d", 4, 1), ("d", 5, 8), ("e", 1, 3), ("f", 2, 7), ("f", 3, 8), ("g", 1, None), ("g", 2, 6)]
    df = spark.createDataFrame(rows, "k string, ver int, val int")
    got = rows_of(ordered.version_diff(df, ["k"], "ver", "val").select("k", "ver", "diff"))
    assert got == [("d", 1, 5), ("d", 2, 4), ("e", 1, 3), ("g", 1, None), ("g", 2, None)]


def test_first_last_only_for_two_versions(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 1), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3)], "k string, ver int, val int")
    assert rows_of(ordered.first_last(df, ["k"], "ver", ["val"])) == [("a", 2, 5, 3)]


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    clean, dirty, empty = [spark.createDataFrame(x, "b int") for x in ([(1,)], [(1,), (None,)], [])]
    assert rows_of(joins.null_aware_anti(left, clean, "a", "b")) == [(2,)]
    assert rows_of(joins.null_aware_anti(left, dirty, "a", "b")) == []
    assert len(rows_of(joins.null_aware_anti(left, empty, "a", "b"))) == 3


@pytest.mark.parametrize("fragments", [1, 3, None])
def test_pair_all_gives_every_pair(spark, fragments):
    left = spark.createDataFrame([(i,) for i in range(20)], "a int")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "b int, name string")
    got = rows_of(joins.pair_all(left, right, fragments))
    assert got == sorted([(a, b, f"n{b}") for a in range(20) for b in range(5)], key=repr)


def test_overlap_finds_shared_days_only(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 4), ("y", 1, 1), ("y", 2, 62), ("z", 1, 127)], "k string, tpl int, frequency int")
    got = joins.overlapping_assignments(df, ["k"], "tpl", "frequency")
    assert rows_of(got.select("k", "tpl", "overlap_mask", "owners")) == [("x", 1, 4, 2), ("x", 2, 4, 2)]


def test_overlap_broadcasts_no_exploded_rows(spark):
    """The days of a mask outnumber the rows the planner sizes; a broadcast of them goes through the driver."""
    df = spark.createDataFrame([("x", 1, 127), ("x", 2, 127), ("y", 1, 3)], "k string, tpl int, frequency int")
    got = joins.overlapping_assignments(df, ["k"], "tpl", "frequency")
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows_of(got.select("k", "tpl", "overlap_mask", "owners")) == [("x", 1, 127, 2), ("x", 2, 127, 2)]


@pytest.mark.parametrize("dealt", [1, 7, 1_000])
def test_overlap_pairs_equal_brute_force(spark, dealt):
    """Each pair once, of a hot key too; repeated rows, nulls, masks without a shared day."""
    rng = random.Random(11)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([*range(9), None]), i // 2,
             rng.choice([0, 1, 5, 4, 62, 64, 127, None])) for i in range(160)]
    data += data[:40]
    got = joins.overlapping_pairs(spark.createDataFrame(data, "k string, tpl int, seq int, frequency int"), ["k"], "tpl", "frequency", dealt)
    assert got.columns == ["k", "tpl", "seq", "frequency", "other_tpl", "other_seq", "other_frequency", "shared_mask"]
    rows = {r for r in data if None not in (r[0], r[1], r[3])}
    want = [(*a, *b[1:], a[3] & b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] > b[1] and a[3] & b[3]]
    assert rows_of(got) == sorted(want, key=repr) and any(r[0] == "hot" for r in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan


def test_overlap_query_lists_every_pair(spark, tmp_path):
    """The report's self join: two templates of an account, brand and type that share a day are one row."""
    spark.range(3, 60).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    items = {}
    for r in Frames(spark, str(tmp_path)).assignments.collect():
        items.setdefault((r.account_id, r.brand_no, r.manifest_type_id), set()).add((r.template_id, r.sequence_id, r.frequency))
    want = [(k[0], k[1], *a, *b, a[2] & b[2]) for k, rows in items.items() for a in rows for b in rows if a[0] > b[0] and a[2] & b[2]]
    got = QUERIES["join_self_overlap"](spark, str(tmp_path))
    assert rows_of(got.select("account_id", "brand_no", "template_id", "sequence_id", "frequency", "other_template_id",
                              "other_sequence_id", "other_frequency", "shared_mask")) == sorted(want, key=repr)
    assert want and all(r.shared_mask == r.overlap_mask == r.other_overlap_mask and r.owners == r.other_owners == 2 for r in got.collect())


def test_unassigned_shuffles_the_assignments(spark):
    """Assignments are far more rows than the table the planner sizes them by; a broadcast of them fills each task."""
    pairs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (None, 12, 1)], "account_id long, publication_id long, brand_no int")
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 1, 2)], "account_id long, brand_no int, manifest_type_id int")
    for kind, want in ((None, [(1, 11), (None, 12)]), (1, [(1, 11), (2, 10), (None, 12)])):
        got = schedules.unassigned(pairs, items, kind)
        got.collect()
        assert rows_of(got.select("account_id", "publication_id")) == sorted(want, key=repr)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_schedule_join_equals_bit_test(spark):
    rng = random.Random(3)
    sched = [(rng.randrange(5), rng.randrange(128), i) for i in range(40)]
    fact = [(rng.randrange(5), rng.randrange(1, 8), i) for i in range(100)]
    out = joins.join_on_schedule(spark.createDataFrame(fact, "k int, draw_weekday int, f int"),
                                 spark.createDataFrame(sched, "k int, frequency int, s int"), ["k"])
    want = sorted((f[2], s[2]) for f in fact for s in sched if f[0] == s[0] and s[1] & (1 << (f[1] - 1)))
    assert sorted((r.f, r.s) for r in out.collect()) == want


def test_schedule_join_shuffles_the_days(spark):
    """The days of the masks outnumber the rows the planner sizes them by; a broadcast of them fills each task."""
    sched = spark.createDataFrame([(1, 127, 0), (1, 1, 1), (None, 127, 2)], "k int, frequency int, s int")
    fact = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (None, 1, 2)], "k int, draw_weekday int, f int")
    out = joins.join_on_schedule(fact, sched, ["k"])
    assert sorted((r.f, r.s) for r in out.collect()) == [(0, 0), (0, 1), (1, 0)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_unpivot_reverses_flatten(spark):
    rng = random.Random(5)
    cells = [(k, w, rng.randrange(100)) for k in range(6) for w in range(1, 8) if rng.random() < 0.7]
    df = spark.createDataFrame(cells, "k int, weekday int, amount int")
    back = agg.unpivot_week(agg.flatten_week(df, ["k"], "weekday", {"amount": ""}), ["k"])
    assert rows_of(back.select("k", "weekday", "amount")) == rows_of(df)


def test_pivot_refuses_too_many_columns(spark):
    df = spark.range(20).withColumn("v", F.lit(1))
    with pytest.raises(ValueError):
        agg.distinct_values(df, "id", 10)


def test_diff_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert [(r.k, r.status) for r in sets.diff_tables(a, b, ["k"], ["v"]).orderBy("k").collect()] == [
        (1, "left only"), (2, "changed"), (3, "same"), (4, "right only")]


def test_extreme_rows_keep_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id int, v int")
    assert rows_of(sorting.extreme_rows(df, "v")) == [(2, 9), (3, 9)]


def test_gaps_skip_split_accounts(spark):
    items = spark.createDataFrame([(10, 1, 1, 50), (10, 1, 2, 50), (10, 2, 1, 60), (10, 2, 2, 61)],
                                  "sequence_id int, account_id int, brand_no int, sequence int")
    brands = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)], "account_id int, brand_no int")
    assert rows_of(schedules.fill_gaps(items, brands).select("sequence_id", "account_id", "brand_no", "sequence")) == [(10, 1, 3, 50)]


def test_zero_months(spark):
    rows = [("a", dt.date(2023, 12, 1), 0), ("a", dt.date(2023, 6, 1), 4), ("b", dt.date(2023, 12, 1), 3)]
    df = spark.createDataFrame(rows, "k string, draw_date date, draw_amount int")
    # seven months back is the first window edge that still excludes 1 June
    assert rows_of(sales.zero_draw_months(df, ["k"], "2024-01-01")) == [("a", 7)]


def test_transfer_states(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, None, None, None), (2, t, None, None, None), (3, t, t, None, None), (4, t, t, t, None),
                                (5, t, t, t, t), (6, None, t, None, None)],
                               "id int, dl_start timestamp_ntz, dl_end timestamp_ntz, ul_start timestamp_ntz, ul_end timestamp_ntz")
    assert [r.state_id for r in logs.transfer_state(df).orderBy("id").collect()] == [7, 10, 11, 12, 13, None]


def test_decremented(spark):
    df = spark.createDataFrame([("a", 1, "5"), ("a", 2, "3"), ("b", 1, "1"), ("b", 2, "4")], "k string, audit_id int, audit_value string")
    assert rows_of(audits.decremented(df, ["k"])) == [("a", 5, 3)]


def test_weekday_dates_ignore_nulls(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "k int, draw_weekday int")
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(3_000)] + [(None,)]
    got = joins.with_weekday_dates(df, spark.createDataFrame(days + days[:5], "draw_date date"))
    assert got.columns == ["k", "draw_weekday", "draw_date"]
    assert got.groupBy("k").count().orderBy("k").collect() == [(1, 429), (2, 429)]


def test_ids_wider_than_the_padding_stay_whole(spark):
    df = spark.createDataFrame([(1234567,), (7,), (None,)], "a long")
    assert [r[0] for r in df.select(zero_pad("a", 6)).collect()] == ["1234567", "000007", None]


def test_overall_numbers_split_equal_first_values(spark):
    df = spark.range(5000).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    got = ordered.numbered_overall(df, ["a", "b"], "rn", rows_per_range=500)
    assert got.where("rn != b + 1").count() == 0 and got.count() == 5000
    assert ordered.numbered_overall(df.where("false"), ["a", "b"]).count() == 0


def test_a_busy_day_is_spread_over_many_ranges(spark):
    quiet = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 86_400).alias("ts"))
    busy = spark.range(1000).select(F.timestamp_seconds(F.lit(500 * 86_400) + F.col("id") * 60).alias("ts"))
    rows = quiet.unionByName(busy)
    ranges = ordered.ranges(rows, "ts")
    assert busy.select(ranges.alias("r")).distinct().count() > 20


def test_dated_sequence_shuffles_the_history(spark):
    """The history is far more rows than the table the planner sizes it by; a broadcast of it fills each task."""
    day = dt.date(2024, 1, 8)
    facts = spark.createDataFrame([(1, 1, day, 2, 10, 9), (2, 1, day, 2, 5, 4)], "account_id long, brand_no int, draw_date date, draw_weekday int, draw_amount int, net int")
    dated = spark.createDataFrame([(7, day)], "template_id int, manifest_date date")
    items = spark.createDataFrame([(7, 1, 1, 2, None, None), (8, 2, 1, 1, None, None)], "template_id int, account_id long, brand_no int, frequency int, valid_from date, valid_to date")
    out = schedules.draw_by_dated_sequence(facts, items, dated)
    assert sorted((r.template_id, r.account_id) for r in out.collect()) == [(7, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "Inner" in line]


def test_an_item_that_left_shows_on_its_old_manifests(spark):
    import datetime as dt

    from pressroute.plans import schedules

    monday, later = dt.date(2024, 1, 8), dt.date(2024, 2, 5)
    facts = spark.createDataFrame([(1, 1, d, 2, 10, 9) for d in (monday, later)], "account_id long, brand_no int, draw_date date, draw_weekday int, draw_amount int, net int")
    dated = spark.createDataFrame([(7, monday), (7, later), (8, later)], "template_id int, manifest_date date")
    schema = "template_id int, account_id long, brand_no int, frequency int, valid_from date, valid_to date"

    def shown(*items):
        out = schedules.draw_by_dated_sequence(facts, spark.createDataFrame(list(items), schema), dated)
        return sorted((r.template_id, r.draw_date) for r in out.collect())

    assert shown((7, 1, 1, 2, None, dt.date(2024, 2, 1))) == [(7, monday)]  # left: its old manifest alone, its mask counts no more
    assert shown((7, 1, 1, 1, dt.date(2024, 2, 5), None)) == [(7, later)]  # came that day, other weekday in its mask
    assert shown((7, 1, 1, 2, dt.date(2024, 2, 5), None), (7, 1, 1, 4, None, monday)) == [(7, monday), (7, later)]  # present mask holds Mondays
    assert shown((9, 1, 1, 1, None, None)) == []
