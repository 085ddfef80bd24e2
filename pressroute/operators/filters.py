"""Row filters. A filter whose argument is None keeps every row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def optional_eq(df: DataFrame, column: str, value=None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def optional_between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(high))
    return df


def like_any_case(column: str, pattern: str) -> Column:
    """LIKE under a case-insensitive collation."""
    return F.col(column).ilike(pattern)


def around(ts: str, instant: str, minutes: int) -> Column:
    """Within plus or minus ``minutes`` of an instant. Constant bounds, so the scan can skip row groups."""
    at = dt.datetime.fromisoformat(instant)
    span = dt.timedelta(minutes=minutes)
    return F.col(ts).between(_ntz(at - span), _ntz(at + span))


def same_day(ts: str, day: str) -> Column:
    """All times of one day, as a half-open range on the bare column."""
    start = dt.datetime.fromisoformat(day)
    return (F.col(ts) >= _ntz(start)) & (F.col(ts) < _ntz(start + dt.timedelta(days=1)))


def search_text(df: DataFrame, text_column: str, text: str, ts: str, start: str, stop: str) -> DataFrame:
    lo, hi = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(stop)
    return df.where(F.col(ts).between(_ntz(lo), _ntz(hi)) & F.col(text_column).contains(text))


def _ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
