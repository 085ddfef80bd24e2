"""The polled reports as Structured Streaming jobs.

Every job takes a streaming DataFrame and returns one; ``run_once`` drives it over what is
on file. Event times carry a watermark, so state is dropped when its time has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pressroute.functions.dates import slot_start
from pressroute.operators.ordered import ranges
from pressroute.plans.logs import transfer_state
from pressroute.session import shared_folder


def read_stream(spark: SparkSession, base: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """One table as a stream, be it a file or a folder of part files; the schema is that of what is present."""
    path = f"{base.rstrip('/')}/{table}.parquet"
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if any(f.rsplit("/", 1)[-1] == f"{table}.parquet" for f in now.inputFiles()):  # one file: a stream needs its folder
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(base)
    return reader.parquet(path)


def event_time(sdf: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on a column; a zone-less time is read as session time."""
    return sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_counts(sdf: DataFrame, ts: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Entries per time slot and key. Counts combine map-side, so a hot key costs one row per task and slot."""
    return (event_time(sdf, ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("entries"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("slot"), *keys, "entries"))


def stream_dedupe(sdf: DataFrame, ts: str, keys: list[str], horizon: str) -> DataFrame:
    """The same message is let through once per horizon."""
    return event_time(sdf, ts, horizon).dropDuplicatesWithinWatermark(keys)


def stream_monitor(transfers: DataFrame, ts: str, horizon: str) -> DataFrame:
    """Transfers seen in a downloading or uploading state, each captured once."""
    stuck = transfer_state(transfers).where(F.col("state_id").isin(10, 12))
    return event_time(stuck, ts, horizon).dropDuplicatesWithinWatermark(["transfer_id"])


def split_late(sdf: DataFrame, business_date: str, uploaded: str) -> DataFrame:
    """Rows marked late when they arrive on the day after their business date. No state is kept."""
    return sdf.withColumn("late", F.coalesce(F.datediff(uploaded, business_date) == 1, F.lit(False)).cast("int"))


def stream_runs(starts: DataFrame, ends: DataFrame, run: str, delay: str, horizon: str) -> DataFrame:
    """Start and end messages of a run joined by its id; a run whose end is lost times out with no end.

    ``starts`` has (run, started), ``ends`` has (run, ended).
    """
    s = event_time(starts, "started", delay)
    e = event_time(ends.withColumnRenamed(run, "__run"), "ended", delay)
    within = (F.col(run) == F.col("__run")) & (F.col("ended") >= F.col("started")) & (
        F.col("ended") <= F.col("started") + F.expr(f"interval {horizon}"))
    return s.join(e, within, "leftOuter").drop("__run")


def stream_pairs(messages: DataFrame, keys: list[str], ts: str, row: str, is_start: str, delay: str, horizon_seconds: int) -> DataFrame:
    """Each start with the first end of the same keys strictly after it and within the horizon; messages carry no run id.

    ``messages`` has ``keys``, a time, the id of the message and whether it is a start (else an end). Give the
    result to ``capture`` in update mode: a start is told at once with no end, and again when an end is found or,
    since rows arrive out of order, an earlier one. ``latest_versions`` keeps the last word. The state of a key
    holds the starts whose horizon is still open and the ends that a start yet to come may need; an event-time
    timer drops what the watermark has passed, so a lost end leaves its start without one and costs no state.
    """
    horizon = horizon_seconds * 1_000_000
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    rows = event_time(messages, ts, delay).withColumn("__micros", F.unix_micros(F.col(ts)))
    out = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, {row} {kinds[row]}, started_micros long, ended_micros long"

    def pair(key, frames: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        starts, ids, known, ends = (np.array(c, np.int64) for c in (state.get if state.exists else ([], [], [], [])))
        before = len(starts)
        if not state.hasTimedOut:
            new = pd.concat(list(frames))
            opened = new[new[is_start].astype(bool)]
            starts = np.concatenate([starts, opened["__micros"].to_numpy(np.int64)])
            ids = np.concatenate([ids, opened[row].to_numpy(np.int64)])
            known = np.concatenate([known, np.zeros(len(opened), np.int64)])
            ends = np.sort(np.concatenate([ends, new.loc[~new[is_start].astype(bool), "__micros"].to_numpy(np.int64)]))
            place = np.searchsorted(ends, starts, side="right")
            following = np.append(ends, 0)[place]
            found = np.where((place < len(ends)) & (following - starts <= horizon), following, 0)
            # an end that has left the state stays known: it is before all that may still come
            found = np.where((known != 0) & ((found == 0) | (known < found)), known, found)
            told = (found != known) | (np.arange(len(starts)) >= before)
            known = found
            if told.any():
                yield pd.DataFrame({**{k: [v] * int(told.sum()) for k, v in zip(keys, key)}, row: ids[told], "started_micros": starts[told],
                                    "ended_micros": pd.array([None if e == 0 else int(e) for e in known[told]], "Int64")})
        passed = state.getCurrentWatermarkMs() * 1000
        keep = starts + horizon > passed
        starts, ids, known, ends = starts[keep], ids[keep], known[keep], ends[ends > passed]
        if len(starts) == 0 and len(ends) == 0:
            state.remove()
        else:
            state.update(tuple(c.tolist() for c in (starts, ids, known, ends)))
            due = [*([int(starts.min()) + horizon] if len(starts) else []), *([int(ends.min())] if len(ends) else [])]
            state.setTimeoutTimestamp(max(min(due), passed) // 1000 + 1)

    paired = rows.select(*keys, ts, row, is_start, "__micros").groupBy(*keys).applyInPandasWithState(
        pair, out, "starts array<long>, ids array<long>, known array<long>, ends array<long>", "update", "EventTimeTimeout")
    return paired.select(*keys, row, *[F.timestamp_micros(f"{c}_micros").cast("timestamp_ntz").alias(c) for c in ("started", "ended")])


def capture(sdf: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch, mode: str = "append"):
    """Append ``each(batch)`` through foreachBatch; a repeated batch overwrites its own folder, so nothing doubles.

    The checkpoint commits a batch after its folder is written. A job that ends between the two, or at any other
    place, goes on from the checkpoint when it is started anew: the batch has its old number and rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return (sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
            .foreachBatch(write).start())


def captured(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``capture`` has written, with the number of the ``batch`` of each row."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").withColumn(
        "batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long"))


def latest_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows told several times, the one of the last batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*")


def slot_parts(ts: str, width: str, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """For ``capture``: the entries of a batch by time slot and key. No state is kept and no row is too late to count."""
    def count(batch: DataFrame) -> DataFrame:
        at = F.col(ts).cast("timestamp")
        return batch.groupBy(F.window(at, width)["start"].cast("timestamp_ntz").alias("slot"), *keys).agg(
            F.count(F.lit(1)).alias("entries"), F.max(at).cast("timestamp_ntz").alias("newest"))
    return count


def merged_slots(parts: DataFrame, keys: list[str], width: Column, delay: Column) -> DataFrame:
    """``slot, keys, entries, late_entries`` of the parts of all batches.

    ``late_entries`` came when their slot was closed: its end was ``delay`` or more before the newest time of the
    batches before. A report that printed closed slots corrects itself by them; ``entries`` has them in.
    """
    newest = parts.groupBy("batch").agg(F.max("newest").alias("newest"))
    earlier = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # one row a batch
    closed = newest.select("batch", (F.max("newest").over(earlier) - delay).alias("closed"))
    late = F.coalesce(F.col("slot") + width <= F.col("closed"), F.lit(False))
    return parts.join(closed, "batch").groupBy("slot", *keys).agg(
        F.sum("entries").alias("entries"), F.sum(F.when(late, F.col("entries")).otherwise(0)).alias("late_entries"))


def as_files_arrive(rows: DataFrame, arrived: Column, files: int, purpose: str) -> Iterator[DataFrame]:
    """The rows as a stream over a folder that grows by one delivery at a time, in order of ``arrived``.

    Yields the stream again after each delivery: a job driven over every one of them is restarted from its
    checkpoint as often, and sees a micro-batch or more each time. Deliveries are cut at quantiles.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, purpose)
    timed = rows.withColumn("__arrived", arrived)
    number = ranges(timed, "__arrived", rows_per_range=1 << 60, least=files)
    for delivery in range(files):
        timed.where(number == delivery).drop("__arrived").write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


def with_open_slots(closed: DataFrame, rows: DataFrame, ts: str, width: str, keys: list[str]) -> DataFrame:
    """The slots that a stream has closed and, from the table, those after its last one, which stay open."""
    slots = rows.select(F.window(F.col(ts).cast("timestamp"), width)["start"].cast("timestamp_ntz").alias("slot"), *keys)
    later = slots.where(F.coalesce(F.col("slot") > closed.agg(F.max("slot")).scalar(), F.lit(True)))
    return closed.unionByName(later.groupBy("slot", *keys).agg(F.count(F.lit(1)).alias("entries")))


def with_open_runs(runs: DataFrame, starts: DataFrame, run: str) -> DataFrame:
    """The runs that a stream has let go and, from the table, those that still wait for their end."""
    waiting = starts.join(runs.select(run), run, "left_anti")
    return runs.unionByName(waiting.withColumn("ended", F.lit(None).cast(runs.schema["ended"].dataType)).select(runs.columns))


def run_once(sdf: DataFrame, spark: SparkSession, purpose: str, timeout: int | None = None) -> DataFrame:
    """Drive a job over all files present and read back what it wrote. Waits without end unless ``timeout`` (seconds) is given."""
    path, checkpoint = shared_folder(spark, purpose), shared_folder(spark, f"{purpose}-state")
    job = sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    if timeout is None:
        job.awaitTermination()
    elif not job.awaitTermination(timeout):
        job.stop()
        raise TimeoutError(f"{purpose} did not finish in {timeout} s")
    return spark.read.schema(sdf.schema).parquet(path)


def quarter_hours(log: DataFrame, ts: str) -> DataFrame:
    """The batch form of the slot counts, used to check the stream and for late corrections."""
    return log.groupBy(slot_start(ts, 15).alias("slot")).agg(F.count(F.lit(1)).alias("entries"))
