"""Log, transfer, web and message reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.functions.dates import format_duration, slot_start
from pressroute.functions.text import extract_between, first_path_part, query_param
from pressroute.operators.intervals import aggregate_in_intervals
from pressroute.operators.joins import split_join
from pressroute.operators.ordered import next_marked_after, pair_by_rank, ranges
from pressroute.operators.sets import stack


def run_durations(log: DataFrame, start_like: str, end_like: str, keys: list[str]) -> DataFrame:
    """The nth start message with the nth end message of each group, with the time between."""
    starts = log.where(F.col("message").like(start_like))
    ends = log.where(F.col("message").like(end_like))
    runs = pair_by_rank(starts, ends, keys, "logged_at", "log_id", ranges(log, "logged_at"))
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", "started"), F.date_trunc("second", "ended"))
    return runs.withColumn("seconds", seconds).withColumn(
        "duration", F.when(seconds >= 0, format_duration(seconds)))


def process_summary(log: DataFrame, processes: dict[str, tuple[str, str]], keys: list[str], entries: list[DataFrame] = ()) -> DataFrame:
    """Runs of several processes on one timeline: each start with the first end after it, and data entry by quarter hours.

    Every message is marked as start or end of each process in one pass. ``entries`` are frames of one
    time column, the audit entries; a slot's row says how many there were.
    """
    marks = F.array_compact(F.array(*[F.when(F.col("message").like(like), F.struct(F.lit(name).alias("process"), F.lit(start).alias("is_start")))
                                      for name, pair in processes.items() for like, start in zip(pair, (True, False))]))
    marked = log.select(*keys, "log_id", "logged_at", F.explode(marks).alias("mark")).select(*keys, "log_id", "logged_at", "mark.*")
    runs = next_marked_after(marked, [*keys, "process"], "logged_at", "is_start", "stopped")
    parts = [runs.select("process", *keys, "log_id", F.col("logged_at").alias("started"), "stopped",
                         F.when(F.col("stopped").isNull(), "Incomplete").otherwise("Complete").alias("status"))]
    if entries:
        times = stack([e.select(F.col(e.columns[0]).alias("at")) for e in entries])
        slots = times.where("at is not null").groupBy(slot_start("at", 15).alias("stopped")).agg(F.count(F.lit(1)).alias("n"))
        blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in parts[0].schema if f.name in (*keys, "log_id")}
        parts.append(slots.select(F.lit("DataEntry").alias("process"), *[blank[k] for k in keys], blank["log_id"],
                                  (F.col("stopped") - F.expr("interval 14 minutes")).alias("started"), "stopped",
                                  F.concat(F.col("n").cast("string"), F.lit(" Ret/Adj Audit Records")).alias("status")))
    return stack(parts)


def export_status(controls: DataFrame, log: DataFrame) -> DataFrame:
    """Export runs by group: first start, last end, whether that end is a success or a failure, file line found in the
    log, and the time taken.

    One grouping of the log by group and kind of message in place of three joins.
    """
    kind = (F.when(F.col("message").startswith("signup"), "start").when(F.col("message").startswith("purchase"), "end")
            .when(F.col("message").startswith("click"), "failed").when(F.col("message").startswith("view"), "file"))
    ended = F.when(F.col("kind").isin("end", "failed"), F.struct("logged_at", "log_id"))
    marks = log.withColumn("kind", kind).where("kind is not null").groupBy("group_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("logged_at"))).alias("export_start"),
        F.max(ended)["logged_at"].alias("export_end"),
        F.when(F.max_by("kind", ended) == "end", "SUCCESS").when(F.max_by("kind", ended) == "failed", "FAILURE").alias("status"),
        F.max_by("message", F.when(F.col("kind") == "file", F.col("logged_at"))).alias("file_line"))
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", "export_start"), F.date_trunc("second", "export_end"))
    return controls.join(marks, "group_id", "left").select(
        *controls.columns, "export_start", "export_end", "status", F.when(seconds >= 0, format_duration(seconds)).alias("duration"),
        extract_between("file_line", ': ', "}").alias("file_no"))


def export_draw_range(exports: DataFrame, draws: DataFrame, key: str, date: str, times: list[str]) -> DataFrame:
    """The export runs with ``draw_date_min`` and ``draw_date_max`` of the draws exported in them.

    A draw belongs to every run, from its start to its end, in which one of its export ``times`` falls; runs may
    overlap. As in the report, only draws dated between the first start and the last end are looked at.
    """
    bounds = exports.agg(F.min("export_start").alias("lo"), F.max("export_end").alias("hi"))
    day = F.col(date).cast("timestamp_ntz")
    dated = draws.where((day >= bounds.select("lo").scalar()) & (day <= bounds.select("hi").scalar()))
    points = dated.select(date, F.explode(F.array_compact(F.array(*times))).alias("exported_at"))
    found = aggregate_in_intervals(exports, [key], "export_start", "export_end", points, "exported_at",
                                   {"draw_date_min": (F.min, date), "draw_date_max": (F.max, date)})
    return exports.join(found, key, "left")


def transfer_seconds(transfers: DataFrame) -> DataFrame:
    def took(a, b):
        return F.timestamp_diff("SECOND", F.date_trunc("second", a), F.date_trunc("second", b))
    return transfers.withColumn("dl_seconds", took("dl_start", "dl_end")).withColumn("ul_seconds", took("ul_start", "ul_end"))


def transfer_times(transfers: DataFrame, seconds_per_drop: int = 3) -> DataFrame:
    """Upload time against the rule of thumb of three seconds per drop; more than a minute above it is slow."""
    return (transfer_seconds(transfers).where("ul_seconds is not null")
            .withColumn("expected", F.col("drops") * seconds_per_drop)
            .withColumn("slow", (F.col("ul_seconds") - F.col("expected") > 60).cast("int")))


def late_uploads(transfers: DataFrame) -> DataFrame:
    """Uploads on the day after the manifest date."""
    return transfers.where(F.datediff("ul_start", "mfst_date") == 1)


# Transfer states, id to name.
STATES = {7: "Cancelled", 10: "Downloading", 11: "Downloaded", 12: "Uploading", 13: "Uploaded"}


def transfer_state(transfers: DataFrame) -> DataFrame:
    """State from the pattern of the four times. Any pattern out of order has no state."""
    pattern = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in ("dl_start", "dl_end", "ul_start", "ul_end")])
    by_pattern = {"0000": 7, "1000": 10, "1100": 11, "1110": 12, "1111": 13}
    pairs = F.create_map(*[F.lit(x) for kv in by_pattern.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return transfers.withColumn("state_id", F.try_element_at(pairs, pattern)).withColumn(
        "state", F.try_element_at(names, F.col("state_id")))


def dup_requests(log: DataFrame) -> DataFrame:
    """Drop requests sent more than once for a manifest before its first acknowledgement."""
    rows = log.withColumn("mfst_id", query_param("query", "mfstid")).withColumn("company", first_path_part("page"))
    acks = rows.where(F.col("page").endswith("/ack")).groupBy("mfst_id", "company").agg(F.min("logged_at").alias("acked_at"))
    drops = rows.where(F.col("page").endswith("/drop")).withColumn("drop_id", query_param("query", "dropid"))
    before = split_join(drops, acks, ["mfst_id", "company"]).where("logged_at < acked_at")
    return before.groupBy("company", "mfst_id", "drop_id").agg(F.count(F.lit(1)).alias("requests")).where("requests > 1")


def timeline(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Several logs stacked by time, each row with its origin. The final sort is by ranges, not in one task."""
    return stack([df.select("logged_at", F.lit(origin).alias("origin"), "line") for origin, df in parts]).orderBy(
        "logged_at", "origin", "line")


def message_status(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.to_date("logged_at").alias("day"), "status").agg(F.count(F.lit(1)).alias("messages"))


def transfer_total(transfers: DataFrame) -> DataFrame:
    """Per device, manifest code and day: time from the first upload started that day to the last download finished."""
    up = transfers.where("ul_start is not null").select("device_id", "mfst_code", F.to_date("ul_start").alias("day"),
                                                         F.col("ul_start").alias("up"), F.lit(None).cast("timestamp_ntz").alias("down"))
    down = transfers.where("dl_end is not null").select("device_id", "mfst_code", F.col("mfst_date").alias("day"),
                                                         F.lit(None).cast("timestamp_ntz").alias("up"), F.col("dl_end").alias("down"))
    both = up.unionByName(down).groupBy("device_id", "mfst_code", "day").agg(
        F.min("up").alias("upload_started"), F.max("down").alias("download_finished"))
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", "upload_started"), F.date_trunc("second", "download_finished"))
    return both.where("upload_started is not null and download_finished is not null").withColumn("total_seconds", seconds)


def repeated_requests(log: DataFrame) -> DataFrame:
    """Requests of which the same page and query came more than once."""
    return log.groupBy("page", "query").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("logged_at").alias("first_at"), F.max("logged_at").alias("last_at")).where(
        "occurrences > 1")


def export_parameters(lines: DataFrame, as_of: str) -> DataFrame:
    """Export type, dates and their offsets from a run date, cut out of a setting such as
    ``Returns "StartDate=01/02/2001;EndDate=01/09/2001"``."""
    day = F.lit(as_of).cast("date")
    out = lines.select("*", F.left("setting", F.locate('"', F.col("setting")) - 2).alias("export_type"),
                       F.to_date(extract_between("setting", "StartDate=", ";"), "MM/dd/yyyy").alias("begin_date"),
                       F.to_date(extract_between("setting", "EndDate=", '"'), "MM/dd/yyyy").alias("end_date"))
    return out.withColumn("begin_offset", F.datediff("begin_date", day)).withColumn("end_offset", F.datediff("end_date", day))


def per_minute(log: DataFrame, spine: DataFrame) -> DataFrame:
    """Entries for every minute of a range, minutes without any included."""
    counts = log.groupBy(F.date_trunc("minute", "logged_at").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("entries"))
    return spine.join(counts, "minute", "left").select("minute", F.coalesce("entries", F.lit(0)).alias("entries"))
