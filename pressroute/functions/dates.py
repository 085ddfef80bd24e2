"""Date arithmetic by boundary count, US weekday numbers (Sunday = 1), and fixed-length periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressroute.functions.bits import DAY_NAMES

_SECONDS = {"second": 1, "minute": 60, "hour": 3600}

# Date styles of the original reports, by style number.
STYLES = {
    0: "MMM dd yyyy hh:mma",
    1: "MM/dd/yy",
    21: "yyyy-MM-dd HH:mm:ss.SSS",
    101: "MM/dd/yyyy",
    108: "HH:mm:ss",
    114: "HH:mm:ss:SSS",
    121: "yyyy-MM-dd HH:mm:ss.SSS",
}


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dateadd(unit: str, n, value) -> Column:
    """Add n units; days, weeks and months of a date stay a date."""
    n = F.lit(n) if isinstance(n, int) else n
    value = _col(value)
    if unit in ("day", "week"):
        return F.date_add(value.cast("date"), (n * (7 if unit == "week" else 1)).cast("int"))
    if unit == "month":
        return F.add_months(value.cast("date"), n.cast("int"))
    return value + F.make_dt_interval(secs=(n * _SECONDS[unit]).cast("decimal(18,6)"))


def diff(unit: str, start, stop) -> Column:
    """Number of unit boundaries crossed, not elapsed whole units."""
    start, stop = _col(start), _col(stop)
    if unit == "day":
        return F.datediff(stop, start)
    if unit == "week":  # weeks start on Sunday
        sunday = F.lit("1970-01-04").cast("date")
        return (F.floor(F.datediff(stop, sunday) / 7) - F.floor(F.datediff(start, sunday) / 7)).cast("int")
    if unit == "month":
        return (F.year(stop) - F.year(start)) * 12 + F.month(stop) - F.month(start)
    if unit == "year":
        return F.year(stop) - F.year(start)
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start), F.date_trunc(unit, stop))


def week_number(date) -> Column:
    """Week of the year where 1 January is in week 1 and weeks begin on Sunday."""
    date = _col(date)
    jan1 = F.trunc(date, "year")
    return F.floor((F.dayofyear(date) + F.dayofweek(jan1) - 2) / 7).cast("int") + 1


def day_name(date) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.dayofweek(_col(date)))


def convert_date(value, style: int) -> Column:
    return F.date_format(_col(value), STYLES[style])


def to_datetime(text, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Null when the text is no date."""
    return F.try_to_timestamp(_col(text), F.lit(pattern)).cast("timestamp_ntz")


def trunc(ts, unit: str) -> Column:
    return F.date_trunc(unit, _col(ts))


def next_boundary(ts, unit: str) -> Column:
    return F.date_trunc(unit, _col(ts)) + F.make_dt_interval(
        secs=F.lit(_SECONDS.get(unit, 86400)).cast("decimal(18,6)"))


def slot_start(ts, minutes: int) -> Column:
    """Start of the fixed slot of the day holding ts (15 minutes: 10:07 gives 10:00)."""
    ts = _col(ts)
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    return F.date_trunc("day", ts) + F.make_dt_interval(
        mins=(minute_of_day - minute_of_day % minutes).cast("int"))


def next_named_day(name: str, date) -> Column:
    """Date of the named weekday in the week after the one holding date.

    Weeks here run Sunday to Saturday for the week count, and the named day is
    counted from the Monday of that week, so Sunday comes last.
    """
    date = _col(date)
    monday = F.date_add(date, 2 - F.dayofweek(date))
    offset = {n: i for i, n in enumerate(DAY_NAMES[1:] + DAY_NAMES[:1])}[name]
    return F.date_add(monday, 7 + offset)


def latest_weekday(date, weekday: int) -> Column:
    """Latest date on or before ``date`` that falls on weekday 1..7."""
    date = _col(date)
    return F.date_sub(date, (F.dayofweek(date) - weekday + 7) % 7)


def format_duration(seconds) -> Column:
    """'3h 05m 09s'."""
    s = _col(seconds).cast("bigint")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600).cast("bigint"),
                           F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def shift_hours(ts, hours) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else _col(hours)
    return _col(ts) + F.make_dt_interval(hours=hours.cast("int"))


def period_index(date, start, length) -> Column:
    """Index of the fixed-length period holding date; negative before the start."""
    return F.floor(F.datediff(_col(date), _col(start)) / _col(length)).cast("int")


def period_start(date, start, length) -> Column:
    return F.date_add(_col(start), (period_index(date, start, length) * _col(length)).cast("int"))


def return_cutoff(date, start, length, cutoff_day) -> Column:
    """Start of the current period from the cutoff day on, of the previous period before it."""
    begin = period_start(date, start, length)
    day = F.datediff(_col(date), begin) + 1
    return F.when(day >= _col(cutoff_day), begin).otherwise(F.date_sub(begin, _col(length).cast("int")))


def roll_forward(value, as_of) -> Column:
    """Move a date forward by whole weeks to the last such day on or before as_of."""
    value, as_of = _col(value), _col(as_of)
    weeks = F.floor(F.datediff(as_of, value) / 7).cast("int")
    return F.date_add(value, weeks * 7)


def date_spine(spark: SparkSession, start: str, stop: str, step: str = "1 day", name: str = "date") -> DataFrame:
    """Dates or minutes from start to stop, both included. The size is set by the arguments."""
    kind = "date" if "day" in step or "month" in step else "timestamp_ntz"
    return spark.range(1).select(F.explode(F.expr(
        f"sequence(cast('{start}' as {kind}), cast('{stop}' as {kind}), interval {step})")).alias(name))


def month_calendar(spark: SparkSession, year: int, month: int) -> DataFrame:
    """One row per week, one column per weekday, day numbers inside."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    days = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))
    return calendar_grid(days, "day")


def calendar_grid(days: DataFrame, day: str) -> DataFrame:
    """Calendar of every month in ``days``: year, month, week, then one column per weekday."""
    rows = days.select(
        F.year(day).alias("year"), F.month(day).alias("month"), week_number(day).alias("week"),
        F.dayofweek(day).alias("_dow"), F.dayofmonth(day).alias("_day"))
    return rows.groupBy("year", "month", "week").agg(*[
        F.min(F.when(F.col("_dow") == i + 1, F.col("_day"))).alias(n.lower()) for i, n in enumerate(DAY_NAMES)])
