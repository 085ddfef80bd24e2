"""Row numbers, previous values and next events that spread one hot key over many tasks.

A plain window puts every row of a key in one task. Here the caller names a ``bucket``
that never decreases along the order (an hour, a day, a number range). Rows are
windowed within (key, bucket), and a second, small frame with one row per (key, bucket)
carries counts or edge values from bucket to bucket. That frame is bounded by the
calendar or the number of ranges, not by the rows of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressroute.operators.joins import split_join
from pressroute.session import shared_folder
from pressroute.sources.tables import staged


def ranges(df: DataFrame, column: str, rows_per_range: int = 1_000_000, least: int = 64) -> Column:
    """Range number of a numeric, date or time column, from approximate quantiles of the whole column.

    The number of ranges follows the row count, and busy stretches get more of them, so a day that holds
    a third of all rows is spread over a third of the ranges. The split points only balance the work: the
    result does not depend on them.
    """
    is_time = df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    value = F.unix_micros(F.col(column).cast("timestamp")) if is_time else F.col(column)

    def split_points(parts: int):
        points = [i / parts for i in range(1, parts)]
        return df.select(value.alias("v")).agg(F.percentile_approx("v", points, max(10_000, 10 * parts)).alias("p"), F.count(F.lit(1)).alias("n")).first()

    row = split_points(least)
    if row.n > least * rows_per_range:  # a second pass, for large tables only
        row = split_points(-(-row.n // rows_per_range))
    splits = sorted(set(row.p or []))
    out = F.lit(0)
    if splits:
        out = F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= value))
    return out


def _cell(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Adds keys and bucket as one struct. The struct is never null, and null fields compare equal in it,
    so window, aggregate and join all use the same hash partitioning and the rows are shuffled once."""
    return df.withColumn("__k", F.struct(*[F.col(k) for k in keys], bucket.alias("__b")))


def _along(keys: list[str]):
    return Window.partitionBy(*[F.col(f"__k.{k}") for k in keys]).orderBy("__k.__b")


def numbered(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "rn") -> DataFrame:
    """row_number() over (partition by keys order by order)."""
    rows = _cell(df, keys, bucket)
    counts = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__k", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__k").orderBy(*order)))
    return (local.join(offsets, "__k").withColumn(name, F.col("__rn") + F.col("__off"))
            .drop("__rn", "__off", "__k"))


def numbered_overall(df: DataFrame, order: list[str], name: str = "rn", rows_per_range: int = 1_000_000) -> DataFrame:
    """row_number() over (order by order) of the whole frame.

    Rows are dealt out by ranges of the full sort key, so equal values of its first column do not share a task,
    and written once with the number of their range: what is counted and what is numbered are then the same.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_range))
    dealt = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    rows = staged(dealt, shared_folder(spark, "ranges"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return local.join(offsets, "__range").withColumn(name, F.col("__rn") + F.col("__off")).drop("__rn", "__off", "__range")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column,
             name: str = "prev") -> DataFrame:
    """lag(value) over (partition by keys order by order). ``order`` is column names, ascending."""
    if not all(isinstance(c, str) for c in order):
        raise TypeError("previous() takes column names, in ascending order")
    rows = _cell(df, keys, bucket)
    edges = rows.groupBy("__k").agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("__last"))
    carried = edges.select("__k", F.lag("__last").over(_along(keys)).alias("__carry"))
    local = rows.withColumn("__lag", F.lag(F.struct(F.col(value))).over(Window.partitionBy("__k").orderBy(*order)))
    return (local.join(carried, "__k").withColumn(name, F.coalesce(F.col("__lag"), F.col("__carry"))[value])
            .drop("__lag", "__carry", "__k"))


def next_event_after(starts: DataFrame, events: DataFrame, keys: list[str], ts: str, name: str = "next_ts") -> DataFrame:
    """For each start, the first event of the same keys strictly later; null if there is none.

    Times are split into ranges by the events' own distribution.
    """
    marked = starts.select(F.struct(*starts.columns).alias("__row"), *keys, F.col(ts).alias("__ts"), F.lit(1).alias("__kind"))
    ends = events.select(F.lit(None).cast(marked.schema["__row"].dataType).alias("__row"), *keys,
                         F.col(ts).alias("__ts"), F.lit(0).alias("__kind"))
    return _next_after(marked.unionByName(ends), ranges(ends, "__ts"), keys, name)


def next_marked_after(marked: DataFrame, keys: list[str], ts: str, is_start: str, name: str = "next_ts") -> DataFrame:
    """The same for starts (``is_start``) and events in one frame, which is read once for both. A row may stand in it twice."""
    rest = [c for c in marked.columns if c != is_start]
    rows = marked.select(F.when(F.col(is_start), F.struct(*rest)).alias("__row"), *keys, F.col(ts).alias("__ts"), F.col(is_start).cast("int").alias("__kind"))
    return _next_after(rows, ranges(rows, "__ts"), keys, name)


def _next_after(rows: DataFrame, bucket: Column, keys: list[str], name: str) -> DataFrame:
    both = _cell(rows, keys, bucket)
    event_ts = F.when(F.col("__kind") == 0, F.col("__ts"))
    later = Window.partitionBy("__k").orderBy("__ts", "__kind").rowsBetween(1, Window.unboundedFollowing)
    local = both.withColumn("__local", F.min(event_ts).over(later)).where("__kind = 1")
    firsts = both.groupBy("__k").agg(F.min(event_ts).alias("__first"))
    following = _along(keys).rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select("__k", F.min("__first").over(following).alias("__carry"))
    return local.join(carried, "__k").select("__row.*", F.coalesce("__local", "__carry").alias(name))


def pair_by_rank(starts: DataFrame, ends: DataFrame, keys: list[str], ts: str, tie: str, bucket: Column,
                 how: str = "inner") -> DataFrame:
    """The nth start with the nth end of the same keys. Pairs shift when one end was lost."""
    s = numbered(starts, keys, [ts, tie], bucket, "run").select(*keys, "run", F.col(ts).alias("started"))
    e = numbered(ends, keys, [ts, tie], bucket, "run").select(*keys, "run", F.col(ts).alias("ended"))
    return s.join(e, [*keys, "run"], how)


def latest_with_ties(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows holding the latest time of their keys; ties keep all rows. Aggregates first, then joins on key and time."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(newest, [*keys, ts], "left_semi")


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the highest ``by`` per key, as one aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*")


def earliest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*")


def first_last(df: DataFrame, keys: list[str], by: str, values: list[str], versions: int | None = 2) -> DataFrame:
    """First and last version side by side, for keys with exactly ``versions`` rows (None: two or more)."""
    aggs = [F.count(F.lit(1)).alias("versions")]
    for v in values:
        aggs += [F.min_by(v, by).alias(f"first_{v}"), F.max_by(v, by).alias(f"last_{v}")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.where(F.col("versions") == versions if versions else F.col("versions") > 1)


def last_nonzero(df: DataFrame, keys: list[str], measure: str, date: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.when(F.col(measure) > 0, F.col(date))).alias("last_nonzero"))


def version_diff(df: DataFrame, keys: list[str], version: str, value: str, name: str = "diff") -> DataFrame:
    """Value less the value of version - 1; the first version counts from zero.

    Joins on key and version number, which spreads a key with many versions. Versions from the
    first gap on are not reached from version 1 and are left out.
    """
    before = df.select(*keys, (F.col(version) + 1).alias(version), F.struct(F.col(value)).alias("__before"))
    joined = df.join(before, [*keys, version], "left")
    gaps = joined.where((F.col(version) != 1) & F.col("__before").isNull()).groupBy(*keys).agg(F.min(version).alias("__gap"))
    return (split_join(joined, gaps, keys, "left").where(F.col("__gap").isNull() | (F.col(version) < F.col("__gap")))
            .withColumn(name, F.col(value) - F.when(F.col(version) == 1, 0).otherwise(F.col("__before")[value])).drop("__before", "__gap"))


def resequence(df: DataFrame, keys: list[str], order: list[str], bucket: Column, start: int = 0, step: int = 10,
               name: str = "new_sequence") -> DataFrame:
    return numbered(df, keys, order, bucket, "__pos").withColumn(
        name, F.lit(start) + F.col("__pos") * step).drop("__pos")


def assign_ids(new: DataFrame, existing_max: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Highest existing id plus 1, 2, 3 .. in the given order. ``existing_max`` is a one-cell frame."""
    return numbered_overall(new, order, "__pos").withColumn(
        name, F.coalesce(existing_max.scalar(), F.lit(0)) + F.col("__pos")).drop("__pos")


def next_version(df: DataFrame, history: DataFrame, keys: list[str], version: str, name: str = "next_version") -> DataFrame:
    """isnull(max(version), 0) + 1 inside each key."""
    top = history.groupBy(*keys).agg(F.max(version).alias("__top"))
    return split_join(df, top, keys, "left").withColumn(
        name, F.coalesce(F.col("__top"), F.lit(0)) + 1).drop("__top")


def align_to_group(df: DataFrame, keys: list[str], column: str, how: str = "min") -> DataFrame:
    """Every row takes its group's lowest or highest value; only rows of uneven groups are returned changed."""
    agg = F.min if how == "min" else F.max
    edge = df.groupBy(*keys).agg(agg(column).alias("__edge"))
    return split_join(df, edge, keys).withColumn(f"old_{column}", F.col(column)).withColumn(column, F.col("__edge")).drop("__edge")


def weekly_history(df: DataFrame, keys: list[str], date: str, weekday: str, value: str, weeks: int = 7) -> DataFrame:
    """Value 1 .. n weeks earlier, each null from the first missing week on.

    ``df`` holds one row per key and date, so a window over (key, weekday) is bounded by
    the weeks on file. The row k places back is k weeks old only when no week is missing.
    """
    w = Window.partitionBy(*keys, weekday).orderBy(date)
    back = df.select("*", *[F.lag(F.struct(date, value), k).over(w).alias(f"__{k}") for k in range(1, weeks + 1)])
    for k in range(1, weeks + 1):
        there = F.datediff(F.col(date), F.col(f"__{k}.{date}")) == 7 * k
        back = back.withColumns({f"date_{k}": F.when(there, F.col(f"__{k}.{date}")),
                                 f"{value}_{k}": F.when(there, F.col(f"__{k}.{value}"))})
    return back.drop(*[f"__{k}" for k in range(1, weeks + 1)])
