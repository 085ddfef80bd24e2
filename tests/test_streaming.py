"""Streaming jobs over several small files against the batch result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressroute.session import shared_folder
from pressroute.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def files(spark):
    """Four files in time order; file i holds hours 6i .. 6i+6 and repeats some messages."""
    base = shared_folder(spark, "events")
    for i in range(4):
        rows = [(i * 100 + j, T0 + dt.timedelta(hours=6 * i, minutes=5 * j), f"u{j % 3}", "m") for j in range(72)]
        spark.createDataFrame(rows, "id long, ts timestamp_ntz, user string, message string").coalesce(1).write.parquet(f"{base}/tmp{i}")
    return base


def stream(spark, base):
    schema = "id long, ts timestamp_ntz, user string, message string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/tmp*")


def test_counts_equal_batch_for_closed_slots(spark, files):
    batch = spark.read.parquet(f"{files}/tmp*")
    out = jobs.run_once(jobs.stream_counts(stream(spark, files), "ts", "15 minutes", "10 minutes", ["user"]), spark, "counts")
    last = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = {(r.slot, r.user): r.entries for r in batch.groupBy(F.window("ts", "15 minutes").start.alias("slot"), "user")
            .agg(F.count(F.lit(1)).alias("entries")).collect() if r.slot + dt.timedelta(minutes=15) <= last}
    assert {(r.slot, r.user): r.entries for r in out.collect()} == want


def test_open_slots_complete_the_counts(spark, files):
    batch = spark.read.parquet(f"{files}/tmp*")
    closed = jobs.run_once(jobs.stream_counts(stream(spark, files), "ts", "15 minutes", "10 minutes", ["user"]), spark, "counts")
    got = jobs.with_open_slots(closed, batch, "ts", "15 minutes", ["user"])
    want = batch.groupBy(F.window("ts", "15 minutes").start.alias("slot"), "user").agg(F.count(F.lit(1)).alias("entries"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, jobs.with_open_slots(closed.where("false"), batch, "ts", "15 minutes", ["user"]).collect())) == sorted(map(tuple, want.collect()))


def test_a_table_folder_is_streamed_by_its_exact_name(spark):
    base = shared_folder(spark, "tables")
    spark.range(40).repartition(4).write.parquet(f"{base}/events.parquet")
    spark.range(7).write.parquet(f"{base}/events_old.parquet")
    spark.range(9).coalesce(1).write.parquet(f"{base}/single")
    assert jobs.run_once(jobs.read_stream(spark, base, "events", 1), spark, "folder").count() == 40
    file = [f for f in spark.read.parquet(f"{base}/single").inputFiles()][0].rsplit("/", 1)
    assert jobs.run_once(jobs.read_stream(spark, file[0], file[1].removesuffix(".parquet")), spark, "file").count() == 9


def test_dedupe_lets_one_through_per_horizon(spark, files):
    out = jobs.run_once(jobs.stream_dedupe(stream(spark, files), "ts", ["user", "message"], "2 days"), spark, "dedupe")
    assert sorted(r.user for r in out.collect()) == ["u0", "u1", "u2"]


def test_lost_end_times_out(spark, files):
    s = stream(spark, files)
    starts = s.select(F.col("id").alias("run"), F.col("ts").alias("started"))
    ends = stream(spark, files).where("id % 5 <> 0").select(
        F.col("id").alias("run"), (F.col("ts") + F.expr("interval 90 seconds")).alias("ended"))
    out = jobs.run_once(jobs.stream_runs(starts, ends, "run", "10 minutes", "30 minutes"), spark, "runs")
    cut = T0 + dt.timedelta(hours=20)
    got = {r.run: r.ended is not None for r in out.collect() if r.started < cut}
    want = {i * 100 + j: (i * 100 + j) % 5 != 0 for i in range(4) for j in range(72)
            if T0 + dt.timedelta(hours=6 * i, minutes=5 * j) < cut}
    assert got == want


def test_capture_repeats_nothing(spark, files):
    path, state = shared_folder(spark, "captured"), shared_folder(spark, "captured-state")
    for _ in range(2):  # the second run finds no new files
        q = jobs.capture(stream(spark, files), path, state)
        assert q.awaitTermination(120)
    assert spark.read.parquet(path).count() == 4 * 72


def test_quarter_hours(spark, files):
    out = jobs.quarter_hours(spark.read.parquet(f"{files}/tmp*"), "ts")
    assert out.agg(F.sum("entries")).first()[0] == 4 * 72


def test_a_crash_between_write_and_commit_doubles_nothing(spark, files):
    path, state = shared_folder(spark, "crash"), shared_folder(spark, "crash-state")
    seen = []

    class Crash(Exception):
        pass

    def write(batch, batch_id):  # as in capture, but the first try at the second batch dies after its folder is written
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        seen.append(batch_id)
        if batch_id == 1 and seen.count(1) == 1:
            raise Crash

    job = (stream(spark, files).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start())
    with pytest.raises(Exception):
        job.awaitTermination(120)
    assert spark.read.parquet(path).count() == 2 * 72
    assert jobs.capture(stream(spark, files), path, state).awaitTermination(120)
    rows = jobs.captured(spark, path, stream(spark, files).schema)
    assert rows.count() == rows.select("id").distinct().count() == 4 * 72
    assert sorted(r.batch for r in rows.select("batch").distinct().collect()) == [0, 1, 2, 3]


def deliveries(spark, rows, arrived, files):
    return jobs.as_files_arrive(rows, arrived, files, "deliveries")


def test_slots_of_files_out_of_order_are_exact(spark, files):
    rows = spark.read.parquet(f"{files}/tmp*")
    path, state = shared_folder(spark, "slots"), shared_folder(spark, "slots-state")
    backwards = F.lit(T0) - (F.col("ts") - F.lit(T0))
    for s in deliveries(spark, rows, backwards, 3):
        assert jobs.capture(s, path, state, each=jobs.slot_parts("ts", "15 minutes", ["user"])).awaitTermination(120)
    parts = jobs.captured(spark, path, "slot timestamp_ntz, user string, entries long, newest timestamp_ntz")
    got = jobs.merged_slots(parts, ["user"], F.expr("interval 15 minutes"), F.expr("interval 10 minutes"))
    want = rows.groupBy(F.window("ts", "15 minutes").start.alias("slot"), "user").agg(F.count(F.lit(1)).alias("entries"))
    assert sorted((r.slot, r.user, r.entries) for r in got.collect()) == sorted(map(tuple, want.collect()))
    late = {r.slot: r.late_entries for r in got.groupBy("slot").agg(F.sum("late_entries").alias("late_entries")).collect()}
    assert late[T0] == 3 and late[T0 + dt.timedelta(hours=23, minutes=45)] == 0


@pytest.mark.parametrize("horizon", [300, 4000])
def test_pairs_of_messages_without_a_run_id(spark, horizon):
    """Starts and ends of hot and rare keys, out of order inside and across deliveries, ends lost, equal times."""
    import random

    rng = random.Random(horizon)
    log = [(i, rng.choice("aaab"), T0 + dt.timedelta(seconds=rng.randrange(20_000)), rng.random() < 0.6) for i in range(400)]
    log += [(900 + i, "lost", T0 + dt.timedelta(seconds=100 * i), True) for i in range(5)]
    rows = spark.createDataFrame(log, "id long, key string, at timestamp_ntz, opens boolean")
    path, state = shared_folder(spark, "pairs"), shared_folder(spark, "pairs-state")
    for s in deliveries(spark, rows, F.col("at") + F.make_dt_interval(secs=(F.col("id") % 500).cast("decimal(18,6)")), 3):
        sdf = jobs.stream_pairs(s, ["key"], "at", "id", "opens", "15 minutes", horizon)
        assert jobs.capture(sdf, path, state, mode="update").awaitTermination(120)
    got = jobs.latest_versions(jobs.captured(spark, path, sdf.schema), ["key", "id"])
    want = []
    for i, key, at, opens in log:
        if opens:
            later = [e for _, k, e, o in log if k == key and not o and at < e <= at + dt.timedelta(seconds=horizon)]
            want.append((key, i, at, min(later, default=None)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
