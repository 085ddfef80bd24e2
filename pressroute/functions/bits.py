"""Weekday bitmasks: bit 1 is Sunday, bit 64 is Saturday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Weekday codes in bit order.
DAY_CODES = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day_bit(date) -> Column:
    """1, 2, 4 .. 64 for Sunday .. Saturday."""
    return F.call_function("shiftleft", F.lit(1), F.dayofweek(_col(date)) - 1)


def freq_matches(freq, mask) -> Column:
    mask = F.lit(mask) if isinstance(mask, int) else _col(mask)
    return _col(freq).bitwiseAND(mask) > 0


def not_single_day(freq) -> Column:
    return F.bit_count(_col(freq)) != 1


def day_list(freq) -> Column:
    """'SUN, MON' for mask 3; empty text for mask 0; null for null."""
    freq = _col(freq)
    names = F.array_compact(F.array(*[
        F.when(freq.bitwiseAND(1 << i) > 0, F.lit(code)) for i, code in enumerate(DAY_CODES)]))
    return F.when(freq.isNotNull(), F.array_join(names, ", "))


def day_flags(freq) -> list[Column]:
    """Seven columns sun .. sat holding ' X ' or ' - '."""
    return [F.when(_col(freq).bitwiseAND(1 << i) > 0, " X ").otherwise(" - ").alias(code.lower())
            for i, code in enumerate(DAY_CODES)]


def first_day(freq) -> Column:
    """1..7: the first day set, Sunday first."""
    out = F.lit(None).cast("int")
    for i in reversed(range(7)):
        out = F.when(_col(freq).bitwiseAND(1 << i) > 0, i + 1).otherwise(out)
    return out


def weekdays_of(freq) -> Column:
    """Array of the weekday numbers 1..7 set in a mask, to explode into an equi-join key."""
    freq = _col(freq)
    return F.array_compact(F.array(*[
        F.when(freq.bitwiseAND(1 << i) > 0, F.lit(i + 1)) for i in range(7)]))


def frequency_catalogue(spark: SparkSession) -> DataFrame:
    """Masks 1..126 with their day list, ranked by length of the list, first day, mask.

    The window has no partition key because the frame always holds 126 rows.
    """
    masks = spark.range(1, 127).select(F.col("id").cast("int").alias("frequency"))
    masks = masks.withColumn("day_list", day_list("frequency"))
    order = Window.orderBy(F.length("day_list"), first_day("frequency"), "frequency")
    return masks.withColumn("sort_order", F.row_number().over(order))
