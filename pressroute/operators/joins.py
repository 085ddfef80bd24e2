"""Joins. No broadcast hints but one on seven rows: the optimizer and adaptive execution broadcast a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``, and split skewed partitions otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.functions.bits import weekdays_of


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other; key columns come once, from the left."""
    renamed = right.select([F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    on = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of a table with one row per key on the right, safe for a left side with a hot key.

    An aggregate by the same keys hands its partitioning on to the join, and adaptive
    execution splits only sides that come straight from a shuffle. Joining on the hash of
    the keys as well makes Spark shuffle the (smaller) right side anew, and a hot
    partition of the left side is then split over many tasks.
    """
    tag = F.xxhash64(*keys)
    return left.withColumn("__tag", tag).join(right.withColumn("__tag", tag), [*keys, "__tag"], how).drop("__tag")


def full_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join, keys coalesced."""
    return left.join(right, keys, "full")


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``NOT IN (subquery)``: a null on the right empties the result, a null on the left is never kept
    unless the right side is empty.

    Built from an ordinary anti join and one scalar, so that a large right side is shuffled;
    Spark's own null-aware anti join would broadcast it. The scalar is 2 for an empty list,
    1 for a list without nulls, 0 for one with; a row stays when that and its own
    not-null (0 or 1) make 2.
    """
    listed = right.select(F.col(right_key).alias("__key"))
    verdict = listed.agg(F.when(F.count(F.lit(1)) == 0, 2).when(F.count_if(F.col("__key").isNull()) == 0, 1).otherwise(0)).scalar()
    on = (F.col(left_key) == F.col("__key")) & (F.xxhash64(left_key) == F.xxhash64("__key"))  # as in split_join
    found = left.join(listed.where("__key is not null").distinct(), on, "left_anti")
    return found.where(verdict + F.col(left_key).isNotNull().cast("int") >= 2)


def pair_all(df: DataFrame, small: DataFrame, fragments: int | None = None) -> DataFrame:
    """Every row of ``df`` with every row of ``small`` (a join written ``on 1 = 1``).

    ``small`` is copied once per fragment and joined on the fragment number, so neither side has to
    fit in one task, whatever its size. There are as many fragments as shuffle partitions.
    """
    fragments = fragments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(fragments)))
    right = small.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(fragments - 1).cast("bigint"))))
    return left.join(right, "__part").drop("__part")


def pair_with_dates(df: DataFrame, start, stop, name: str = "date") -> DataFrame:
    """Every row with every date of a closed range, expanded in place."""
    start, stop = [F.lit(x).cast("date") if isinstance(x, str) else x for x in (start, stop)]
    return df.withColumn(name, F.explode(F.sequence(start, stop)))


def on_weekday(schedule: DataFrame, frequency: str = "frequency", weekday: str = "draw_weekday") -> DataFrame:
    """One row per day in the mask, so that a bitmask test becomes an equality on the weekday."""
    return schedule.withColumn(weekday, F.explode(weekdays_of(frequency)))


def join_on_schedule(fact: DataFrame, schedule: DataFrame, keys: list[str],
                     weekday: str = "draw_weekday", frequency: str = "frequency") -> DataFrame:
    """Fact rows with each schedule row whose mask holds the fact's weekday.

    The days are sized by the planner from the rows before the explode, many times fewer: shuffled, not broadcast.
    """
    return fact.join(on_weekday(schedule, frequency, weekday).hint("merge"), [*keys, weekday])


def with_weekday_dates(df: DataFrame, dates: DataFrame, weekday: str = "draw_weekday", name: str = "draw_date") -> DataFrame:
    """Each row with every listed date that falls on its weekday. Null dates and null weekdays match nothing.

    A shuffle on seven weekdays would fill seven tasks. The dates are grouped into one list per weekday
    instead: seven rows that hold no more than the calendar's days (a century has 36,525), which is why they
    may be broadcast at any size of the tables. Rows expand in place.
    """
    lists = (dates.where(F.col(name).isNotNull()).groupBy(F.dayofweek(name).alias(weekday))
             .agg(F.sort_array(F.collect_set(name)).alias("__dates")))
    return df.join(F.broadcast(lists), weekday).withColumn(name, F.explode("__dates")).drop("__dates").select(*df.columns, name)


def join_minute(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, how: str = "inner") -> DataFrame:
    """Join on times cut to the minute."""
    return left.withColumn("minute", F.date_trunc("minute", left_ts)).join(
        right.withColumn("minute", F.date_trunc("minute", right_ts)), "minute", how)


def overlapping_assignments(df: DataFrame, keys: list[str], owner: str, frequency: str) -> DataFrame:
    """Assignments that share a day with another owner's assignment of the same keys.

    Counts owners per key and day instead of pairing rows with each other, so a hot
    key costs its rows, not their square. ``overlap_mask`` holds the shared days,
    ``owners`` the most owners found on one of them.
    """
    by_day = on_weekday(df, frequency, "__day")
    crowded = (by_day.groupBy(*keys, "__day").agg(F.count_distinct(owner).alias("__owners"))
               .where("__owners > 1"))
    # by_day is sized by the planner from the input before the explode, which can be many times smaller:
    # a broadcast of it would pass every row through the driver. It is shuffled, as is crowded.
    hits = split_join(by_day.hint("merge"), crowded, [*keys, "__day"])
    return hits.groupBy(*df.columns).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("__day") - 1)).alias("overlap_mask"),
        F.max("__owners").alias("owners"))


def overlapping_pairs(df: DataFrame, keys: list[str], owner: str, frequency: str, dealt: int = 1_000) -> DataFrame:
    """Every two assignments of the same keys, by different owners, that share a day: each pair once.

    The row of the greater owner comes first, the other's columns follow as ``other_..``, ``shared_mask`` holds the
    days the two share. Repeated rows count once; null keys, owners and masks pair with nothing. A self join on the
    keys with the masks as a further condition. A hot key's rows are dealt over one part for each ``dealt`` of them
    and met there by all of its rows, so its pairs are found by many tasks.
    """
    rows = df.distinct()
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / dealt).alias("__parts"))
    # rows may come from an explode, and the copies do: as in overlapping_assignments, shuffled at any size.
    sized = split_join(rows.hint("merge"), parts, keys)
    left = sized.withColumn("__part", F.pmod(F.xxhash64(*df.columns), "__parts")).drop("__parts")
    right = sized.select(*keys, *[F.col(c).alias(f"other_{c}") for c in df.columns if c not in keys],
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1)).alias("__part"))
    shared = F.col(frequency).bitwiseAND(F.col(f"other_{frequency}")).bitwiseAND(127)
    pairs = left.hint("merge").join(right, [*keys, "__part"]).where((F.col(owner) > F.col(f"other_{owner}")) & (shared > 0))
    return pairs.withColumn("shared_mask", shared).drop("__part")
