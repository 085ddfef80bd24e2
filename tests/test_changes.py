"""Properties of table changes."""

import datetime as dt

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from pressroute.operators import aggregates as agg, changes, sets
from pressroute.plans import accounts, audits, imports
from pressroute.plans.fixtures import random_adjustments, random_returns
from pressroute.session import shared_folder
from pressroute.sources import files, tables

KEYS = ["account_id", "publication_id", "draw_date"]
D = dt.date(2024, 1, 8)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, 1, D, 10, 1.0), (1, 2, D, 20, 1.0), (2, 1, D, 30, 2.0)],
                                 "account_id long, publication_id long, draw_date date, draw_amount long, draw_rate double")


@pytest.fixture(scope="module")
def load(spark):
    return spark.createDataFrame([(1, 1, D, 10, 1.0), (1, 2, D, 25, 1.0), (3, 1, D, 7, 1.0)],
                                 "account_id long, publication_id long, draw_date date, draw_amount long, draw_rate double")


def test_update_changes_matched_rows_only(base, load):
    out = changes.apply_updates(base, load, KEYS, ["draw_amount"])
    assert [r.draw_amount for r in out.orderBy(*KEYS).collect()] == [10, 25, 30]


def test_update_refuses_repeated_keys(base, load):
    with pytest.raises(SparkRuntimeException, match="repeated key"):
        changes.apply_updates(base, load.unionByName(load), KEYS, ["draw_amount"]).collect()


def test_history_holds_the_changed_rows(base, load):
    table, history = changes.apply_with_history(base, load, KEYS, ["draw_amount", "draw_rate"], F.lit("t"), 1)
    assert [(r.account_id, r.publication_id, r.old_draw_amount, r.new_draw_amount) for r in history.collect()] == [(1, 2, 20, 25)]
    changed = table.exceptAll(base).count()
    assert changed == history.count()


def test_import_leaves_other_dates_alone_and_reports_repeats(spark, base, load):
    other = spark.createDataFrame([(1, 1, dt.date(2023, 1, 1), 3, 1.0), (9, 9, dt.date(2024, 1, 9), 4, 1.0)], base.schema)
    again = spark.createDataFrame([(1, 2, D, 24, 1.0), (1, 2, D, 25, 1.0)], load.schema)
    file = load.unionByName(again).withColumn("delivery_date", F.col("draw_date"))
    defaults = spark.createDataFrame([(4, 4, 2, 8, 1.0)], "account_id long, publication_id long, draw_weekday int, draw_amount long, draw_rate double")
    out = imports.import_draws(base.unionByName(other), file, defaults, KEYS, F.lit("t"), 1, fill=True)
    assert rows_of(out["untouched"]) == rows_of(other)
    assert rows_of(out["duplicates"]) == [(1, 2, D, 2)]
    assert [r.draw_amount for r in out["table"].orderBy("draw_date", "account_id", "publication_id").collect()] == [3, 10, 25, 30, 7, 8, 4]
    assert sorted(r.action for r in out["history"].collect()) == ["fill", "insert", "update"]


def test_import_reads_the_months_of_the_file_only(spark):
    path = shared_folder(spark, "months")
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2023-12-31')) as draw_date").select(
        F.lit(1).cast("long").alias("account_id"), F.lit(1).cast("long").alias("publication_id"), "draw_date",
        F.lit(5).cast("long").alias("draw_amount"), F.lit(1.0).alias("draw_rate"))
    tables.write_by_month(days, path, "draw_date")
    file = spark.createDataFrame([(1, 1, dt.date(2023, 6, 3), 6, 1.0)], days.schema)
    touched, rest = imports.on_file_dates(spark.read.parquet(path), file)
    assert touched.count() == 1 and rest.count() == 364
    rows = touched.select("draw_amount")
    rows.collect()
    scan = next(x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x and "month" in x)
    assert "subquery" in scan.split("PartitionFilters:")[1].split("]")[0]
    read = rows._jdf.queryExecution().executedPlan()
    metrics = [m for m in _metrics(read) if m[0] == "number of files read"]
    assert metrics and metrics[0][1] == 1  # of twelve


@pytest.mark.parametrize("changes_,files_read", [({}, 0), ({dt.date(2023, 6, 3): 6}, 1), ({dt.date(2023, 6, 3): 6, dt.date(2023, 8, 9): None}, 3)])
def test_tables_are_compared_where_their_checksums_differ(spark, changes_, files_read):
    """Equal tables are not read again; of others the months between the first and the last difference."""
    columns = "account_id long, draw_date date, draw_amount long"
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    left = [(i % 40, d, 5) for i, d in enumerate(days)]
    right = [(i, d, changes_.get(d, 5)) for i, d, _ in left if changes_.get(d, 5) is not None]
    paths = [shared_folder(spark, "compared") for _ in range(2)]
    for path, rows in zip(paths, (left, right)):
        tables.write_by_month(spark.createDataFrame(rows, columns), path, "draw_date")
    out = sets.differing_rows(*[spark.read.parquet(p) for p in paths], ["account_id", "draw_date"], ["draw_amount"], "month", buckets=4)
    got = {r.draw_date: (r.status, r.right_draw_amount) for r in out.collect()}
    assert got == {d: ("changed", v) if v else ("left only", None) for d, v in changes_.items()}
    read = [v for n, v in _metrics(out._jdf.queryExecution().executedPlan()) if n == "number of files read"]
    assert any(read) == bool(files_read) and all(v <= files_read for v in read)


def test_repeated_and_null_rows_change_the_checksums(spark):
    def differs(a, b):
        schema = "k long, v long"
        return sorted(r.status for r in sets.differing_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], ["v"], buckets=2).collect())

    assert differs([(1, 5), (2, None)], [(2, None), (1, 5)]) == []
    assert differs([(1, 5)], [(1, None)]) == ["changed"]
    assert differs([(1, 5)], [(1, 5), (3, 1), (3, 1)]) == ["right only", "right only"]
    assert differs([], []) == []


def _metrics(plan):
    """(name, value) of the metrics of all nodes of an executed plan."""
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found = [(m._2().name().get(), m._2().value()) for m in _items(plan.metrics()) if m._2().name().isDefined()]
    for child in _items(plan.children()):
        found += _metrics(child)
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        found += _metrics(plan.plan())
    return found


def _items(scala):
    it = scala.iterator()
    while it.hasNext():
        yield it.next()


def test_template_load_numbers_its_history(spark):
    kind = "account_id long, publication_id long, draw_weekday int, draw_amount long, draw_rate double"
    template = spark.createDataFrame([(1, 1, 2, 5, 1.0), (1, 2, 2, 6, 1.0), (1, 3, 3, 7, 1.0)], kind)
    load = spark.createDataFrame([(1, 1, D, 9, 1.0), (1, 1, D - dt.timedelta(7), 8, 1.0), (1, 2, D, 6, 1.0), (2, 2, D, 4, 2.0)],
                                 "account_id long, publication_id long, draw_date date, draw_amount long, draw_rate double")
    existing = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 2, 2)], "account_id long, publication_id long, draw_weekday int, version int")
    out = imports.import_defaults(template, load, existing, F.lit("t"))
    assert rows_of(out["table"]) == [(1, 1, 2, 9, 1.0), (1, 2, 2, 6, 1.0), (1, 3, 3, 7, 1.0), (2, 2, 2, 4, 2.0)]
    assert sorted((r.account_id, r.action, r.old_draw_amount, r.new_draw_amount, r.version) for r in out["history"].collect()) == [
        (1, "update", 5, 9, 3), (2, "insert", 0, 4, 1)]


def test_rows_that_cannot_be_read_are_reported(spark):
    raw = spark.createDataFrame([(" A000001 ", "P2", "01/02/2024", "5", None), ("A1x", "P2", "13/02/2024", "5", "1.5"), (None, "P2", "01/02/2024", "many", "")],
                                "acct_code string, pub_code string, draw_date string, draw_amount string, draw_rate string")
    assert sorted(r.faults for r in imports.load_rejects(raw).collect()) == ["acct_code, draw_amount", "acct_code, draw_date"]
    good = imports.normalise_load(raw).first()
    assert (good.account_id, good.publication_id, good.draw_date, good.draw_amount, good.draw_rate) == (1, 2, dt.date(2024, 1, 2), 5, 0)


def test_import(spark, base, load):
    defaults = spark.createDataFrame([(1, 1, 2, 5, 1.0), (4, 4, 2, 8, 1.0), (4, 4, 3, 9, 1.0)],
                                     "account_id long, publication_id long, draw_weekday int, draw_amount long, draw_rate double")
    file = load.withColumn("delivery_date", F.col("draw_date"))
    out = imports.import_draws(base, file, defaults, KEYS, F.lit("t"), 1)
    assert out["table"].count() == 4
    assert sorted(r.action for r in out["history"].collect()) == ["insert", "update"]
    assert [(r.account_id, r.draw_amount) for r in out["missing"].collect()] == [(4, 8)]  # 2024-01-08 is a Monday


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(12)], "id int, a int, b int")
    once = changes.dedupe_keep_first(df, ["a", "b"], "id")
    assert rows_of(once) == [(i, i % 3, i % 2) for i in range(6)]
    assert rows_of(changes.dedupe_keep_first(once, ["a", "b"], "id")) == rows_of(once)
    assert changes.dedupe_any(df, ["a", "b"]).count() == 6
    assert [r.copies for r in changes.duplicate_report(df, ["a", "b"]).collect()] == [2] * 6


def test_drop_latest_of_repeated_plans(spark):
    df = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False), (4, 2, True), (5, 3, False), (6, 3, False)], "id int, k int, live boolean")
    out = changes.dedupe_drop_latest(df, ["k"], "id", F.col("live"))
    assert [r.id for r in out.orderBy("id").collect()] == [1, 2, 4, 5, 6]


def test_prefer_drops_only_among_several(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 5), (3, "y", 0), (4, "z", None), (5, "z", 1)], "id int, k string, v int")
    assert [r.id for r in changes.dedupe_prefer(df, ["k"], F.col("v") == 0).orderBy("id").collect()] == [2, 3, 4, 5]


def test_retention_parts_are_disjoint_and_whole(spark):
    df = spark.createDataFrame([(i, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(40)] + [(99, None)], "id int, d date")
    old, live = changes.retention_split(df, "d", "2024-01-10", "2024-01-20")
    assert old.count() == 11 and old.join(live, "id").count() == 0 and old.count() + live.count() == df.count()


def test_cascade_leaves_no_orphan(spark):
    parent = spark.createDataFrame([(i,) for i in range(10)], "k int")
    child = spark.createDataFrame([(i % 10, i) for i in range(50)], "k int, v int")
    out = changes.cascade_delete({"child": child, "parent": parent}, parent.where("k < 4"), [("child", ["k"]), ("parent", ["k"])])
    assert out["parent"].count() == 6 and out["child"].join(out["parent"], "k", "left_anti").count() == 0


def test_restore(spark):
    now = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    backup = spark.createDataFrame([(2, 60), (3, 70)], "k int, v int")
    assert rows_of(changes.restore(now, backup, ["k"], ["v"])) == [(1, 5), (2, 60), (3, 70)]


def test_normalise_load(spark):
    raw = spark.createDataFrame([("  A000042 ", "P7", "01/08/2024", " 12 ", None)],
                                "acct_code string, pub_code string, draw_date string, draw_amount string, draw_rate string")
    row = imports.normalise_load(raw).first()
    assert (row.account_id, row.publication_id, row.draw_date, row.draw_weekday, row.draw_amount, float(row.draw_rate)) == (42, 7, D, 2, 12, 0.0)


def test_random_returns_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 50).alias("draw"))
    a = random_returns(df.repartition(3), ["k"], "draw", 1)
    b = random_returns(df.repartition(11), ["k"], "draw", 1)
    assert rows_of(a) == rows_of(b) and all(0 <= r.ret_amount <= r.draw for r in a.collect())


def test_placeholder_goes_when_another_category_exists(spark):
    own = spark.createDataFrame([(1, "Unknown"), (2, "Unknown")], "account_id int, category string")
    wanted = spark.createDataFrame([(1, "News")], "account_id int, category string")
    assert rows_of(accounts.sync_categories(own, wanted, "Unknown")) == [(1, "News"), (2, "Unknown")]


def test_staged_import_gives_the_same(spark, base, load):
    from pressroute.session import shared_folder
    defaults = spark.createDataFrame([], "account_id long, publication_id long, draw_weekday int, draw_amount long, draw_rate double")
    file = load.withColumn("delivery_date", F.col("draw_date"))
    plain = imports.import_draws(base, file, defaults, KEYS, F.lit("t"), 1)
    written = imports.import_draws(base, file, defaults, KEYS, F.lit("t"), 1, shared_folder(spark, "import"))
    for part in ("table", "history", "missing"):
        assert rows_of(plain[part]) == rows_of(written[part])


def test_all_entries_of_a_draw_are_reported(spark):
    rows = [("a", v, v % 3, str(10 * v)) for v in range(1, 7)] + [("b", 1, 1, "5"), ("c", 1, 2, "9"), ("c", 2, 2, "4")]
    log = spark.createDataFrame(rows, "k string, audit_id int, audit_user_id int, audit_value string").withColumn(
        "audit_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    draws = spark.createDataFrame([("a", 60, -1), ("b", 5, 5), ("c", 4, 4)], "k string, draw_amount int, net int")
    got = {r.k: r for r in audits.returns_audit(log, draws, ["k"]).collect()}
    assert set(got) == {"a", "c"} and got["a"].entries == 6
    assert [(e.user, e.value, e.difference) for e in got["a"].entry] == [(v % 3, 10 * v, 10) for v in range(1, 7)]
    assert [e.difference for e in got["c"].entry] == [9, -5]
    assert [r.k for r in audits.returns_audit(log, draws, ["k"], negative_net_only=True).collect()] == ["a"]
    wide = audits.entry_columns(audits.returns_audit(log, draws, ["k"]))
    assert "value6" in wide.columns and "value7" not in wide.columns
    assert {r.k: (r.value1, r.value6) for r in wide.collect()} == {"a": (10, 60), "c": (9, None)}
    flat = {r.k: r for r in agg.pivot_rest(log, ["k"], "audit_id", [1, 2], {"audit_value": "v", "audit_user_id": "u"}).collect()}
    assert flat["a"]["2v"] == "20" and flat["a"].rest == "3=30/0, 4=40/1, 5=50/2, 6=60/0" and flat["b"].rest is None


def test_a_value_wider_than_its_field_fails(spark):
    layout = [("code", 1, 4), ("amount", 5, 10)]
    fits = spark.createDataFrame([("ab", 1234567890), (None, 1)], "code string, amount long")
    path = shared_folder(spark, "fixed")
    files.write_fixed(fits, path, layout)
    assert sorted(map(tuple, files.read_fixed(spark, path, layout).collect()), key=repr) == [("ab", "1234567890"), (None, "1")]
    with pytest.raises(Exception, match="amount: a value is wider"):
        files.write_fixed(spark.createDataFrame([("ab", 123456789012)], "code string, amount long"), shared_folder(spark, "fixed"), layout)


def test_rejects_are_sought_in_the_whole_load(spark, monkeypatch):
    from pressroute.queries import QUERIES

    seen, found = [], imports.load_rejects
    monkeypatch.setattr(imports, "load_rejects", lambda raw: (seen.append((raw.count(), raw.where("kind is null").count())), found(raw))[1])
    codes = [r.code for r in QUERIES["load_rejects"](spark, "/root/testdata/sf0.001").collect()]
    (whole, good), = seen
    assert codes and whole > good > whole / 2 and all(int(c[1:]) % 10 == 0 for c in codes)


def test_a_second_run_adjusts_nothing(spark, base):
    zero = base.withColumn("draw_amount", F.when(F.col("publication_id") == 2, 0).otherwise(F.col("draw_amount")))
    first = random_adjustments(zero, KEYS, "draw_amount", zero.limit(0), 5)
    assert first.count() == 3 and all(-9 <= r.adj_amount <= 9 for r in first.collect())
    assert [r.adj_amount for r in first.where("draw_amount = 0").collect()] == [0]
    assert random_adjustments(zero, KEYS, "draw_amount", first, 5).count() == 0
    assert random_adjustments(zero, KEYS, "draw_amount", first.where("account_id = 1"), 5).count() == 1


def test_entries_beyond_the_bound_are_an_error(spark):
    report = spark.range(1).select(F.lit(5000).alias("entries"), F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.struct(
        i.alias("user"), i.alias("value"), i.alias("difference"), i.alias("time"))).alias("entry"))
    with pytest.raises(ValueError, match="5000 entries.*entry"):
        audits.entry_columns(report)
    few = audits.entry_columns(report.withColumn("entries", F.lit(2)).withColumn("entry", F.slice("entry", 1, 2)))
    assert few.columns == ["entries", *[f"{n}{k}" for k in (1, 2) for n in ("user", "value", "difference", "time")]]
