"""Streaming jobs, each driven over the events on file and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.queries.registry import query
from pressroute.session import shared_folder
from pressroute.sources.frames import Frames
from pressroute.streaming import jobs


class StreamFrames(Frames):
    """The canonical frames over a stream of events."""

    def table(self, name):
        return jobs.read_stream(self.spark, self.base, name)


class DeliveredFrames(Frames):
    """The canonical frames over one stream of events."""

    def __init__(self, t: Frames, stream):
        super().__init__(t.spark, t.base)
        self.stream = stream

    def table(self, name):
        return self.stream if name == "events" else super().table(name)


def _streams(t) -> StreamFrames:
    return StreamFrames(t.spark, t.base)


def _drive(rows, make, purpose, arrived=None, files=3, **options):
    """What a job writes that is started anew after every delivery of the rows, in order of ``arrived`` (by default up to
    ten minutes out of order)."""
    spark = rows.sparkSession
    path, state, schema = shared_folder(spark, purpose), shared_folder(spark, f"{purpose}-state"), None
    arrived = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 600).cast("decimal(18,6)")) if arrived is None else arrived
    for stream in jobs.as_files_arrive(rows, arrived, files, f"{purpose}-files"):
        sdf = make(stream)
        schema = options.get("schema", sdf.schema)
        jobs.capture(sdf, path, state, **{k: v for k, v in options.items() if k != "schema"}).awaitTermination()
    return jobs.captured(spark, path, schema)


@query("tumbling_counts", "", """
    SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS VARCHAR) AS slot, event_type, count(*) AS entries FROM events
    GROUP BY time_bucket(INTERVAL 15 MINUTE, ts), event_type""")
def tumbling_counts(t):
    """Entries per quarter hour and kind. Files come in any order of time; each batch's counts are merged into the slots."""
    parts = _drive(t.table("events"), lambda s: s, "tumbling", arrived=F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 40).cast("int")),
                   each=jobs.slot_parts("ts", "15 minutes", ["event_type"]), schema="slot timestamp_ntz, event_type string, entries long, newest timestamp_ntz")
    return jobs.merged_slots(parts, ["event_type"], F.expr("interval 15 minutes"), F.expr("interval 10 minutes")).drop("late_entries")


@query("closed_slots", "", """
    SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS VARCHAR) AS slot, event_type, count(*) AS entries FROM events
    GROUP BY time_bucket(INTERVAL 15 MINUTE, ts), event_type""")
def closed_slots(t):
    """The same by a watermark: the slots that it has closed, and those still open at the end."""
    counts = jobs.stream_counts(_streams(t).table("events"), "ts", "15 minutes", "10 minutes", ["event_type"])
    return jobs.with_open_slots(jobs.run_once(counts, t.spark, "closed"), t.table("events"), "ts", "15 minutes", ["event_type"])


@query("stream_dedupe", "", """
    SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""")
def stream_dedupe(t):
    """One message per user, kind and day."""
    rows = _streams(t).table("events").withColumn("day", F.to_date("ts"))
    once = jobs.stream_dedupe(rows, "ts", ["user_id", "event_type", "day"], "2 days").select("user_id", "event_type", "day")
    return jobs.run_once(once, t.spark, "dedupe")


@query("stream_error_monitor", "transfers", """
    SELECT transfer_id, CASE WHEN dl_end IS NULL THEN 'Downloading' ELSE 'Uploading' END AS state FROM transfers
    WHERE dl_start IS NOT NULL AND ul_end IS NULL AND (dl_end IS NULL OR ul_start IS NOT NULL)""")
def stream_error_monitor(t):
    """Stuck transfers, each appended once by a job that is restarted between deliveries."""
    def stuck(stream):
        return jobs.stream_monitor(DeliveredFrames(t, stream).transfers, "dl_start", "1 day").select("transfer_id", "state")

    return _drive(t.table("events"), stuck, "monitor").drop("batch")


@query("late_rows", "transfers", """
    SELECT transfer_id, CAST(mfst_date AS VARCHAR) AS mfst_date, CAST(ul_start AS VARCHAR) AS ul_start,
           CAST(coalesce(CAST(ul_start AS DATE) - mfst_date = 1, false) AS INTEGER) AS late FROM transfers""")
def late_rows(t):
    rows = jobs.split_late(_streams(t).transfers, "mfst_date", "ul_start").select("transfer_id", "mfst_date", "ul_start", "late")
    return jobs.run_once(rows, t.spark, "late")


@query("run_sessions", "system_log", """
    WITH e AS (SELECT group_id, logged_at FROM system_log WHERE message LIKE 'purchase%'),
    r AS (SELECT s.group_id, s.log_id, s.logged_at AS started,
                 (SELECT min(e.logged_at) FROM e WHERE e.group_id = s.group_id AND e.logged_at > s.logged_at) AS ended
          FROM system_log s WHERE message LIKE 'signup%')
    SELECT group_id, log_id, CAST(started AS VARCHAR) AS started,
           CASE WHEN ended <= started + INTERVAL 72 HOUR THEN CAST(ended AS VARCHAR) END AS ended FROM r""")
def run_sessions(t):
    """Start and end messages of a group paired by time alone: the first end within three days after each start."""
    def pairs(stream):
        log = DeliveredFrames(t, stream).system_log
        kind = F.when(F.col("message").startswith("signup"), True).when(F.col("message").startswith("purchase"), False)
        return jobs.stream_pairs(log.withColumn("is_start", kind).where("is_start is not null"), ["group_id"], "logged_at", "log_id", "is_start",
                                 "15 minutes", 3 * 24 * 3600)

    return jobs.latest_versions(_drive(t.table("events"), pairs, "sessions", mode="update"), ["group_id", "log_id"])


@query("run_sessions_by_id", "", """
    SELECT event_id AS run, CAST(ts AS VARCHAR) AS started,
           CASE WHEN event_id % 7 <> 0 THEN CAST(ts + to_seconds(CAST(floor(value) AS BIGINT)) AS VARCHAR) END AS ended
    FROM events""")
def run_sessions_by_id(t):
    """All runs: with their end, without one since it was lost, and those that still wait for it."""
    events = _streams(t).table("events")
    ended = F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))

    def starts(rows):
        return rows.select(F.col("event_id").alias("run"), F.col("ts").cast("timestamp").alias("started"))

    ends = events.where("event_id % 7 <> 0").select(F.col("event_id").alias("run"), ended.alias("ended"))
    runs = jobs.run_once(jobs.stream_runs(starts(events), ends, "run", "10 minutes", "1 hour"), t.spark, "runs")
    return jobs.with_open_runs(runs, starts(t.table("events")), "run").select(
        "run", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"))
