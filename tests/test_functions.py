"""Unit cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressroute.functions import bits, dates as d, text as x, values as v


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def date(s):
    return F.lit(s).cast("date")


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize("mask, text", [(0, ""), (1, "SUN"), (3, "SUN, MON"), (62, "MON, TUE, WED, THU, FRI"), (64, "SAT"),
                                        (127, "SUN, MON, TUE, WED, THU, FRI, SAT")])
def test_day_list(spark, mask, text):
    assert one(spark, bits.day_list(F.lit(mask))) == text
    assert one(spark, F.size(bits.weekdays_of(F.lit(mask)))) == bin(mask).count("1")


def test_day_bit_follows_sunday_first(spark):
    # 2024-01-07 is a Sunday
    assert [one(spark, bits.day_bit(date(f"2024-01-{7 + i:02d}"))) for i in range(7)] == [1, 2, 4, 8, 16, 32, 64]


def test_single_day(spark):
    assert [one(spark, bits.not_single_day(F.lit(m))) for m in (0, 1, 3, 64)] == [True, False, True, False]


def test_catalogue(spark):
    rows = bits.frequency_catalogue(spark).orderBy("sort_order").collect()
    assert len(rows) == 126 and [r.frequency for r in rows[:7]] == [1, 2, 4, 8, 16, 32, 64]


@pytest.mark.parametrize("unit, a, b, n", [
    ("minute", "2024-01-01 10:00:59", "2024-01-01 10:01:00", 1), ("hour", "2024-01-01 10:59:59", "2024-01-01 11:00:00", 1),
    ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1), ("month", "2024-01-31 00:00:00", "2024-02-01 00:00:00", 1),
    ("year", "2023-12-31 00:00:00", "2024-01-01 00:00:00", 1), ("week", "2024-01-06 00:00:00", "2024-01-07 00:00:00", 1),
    ("week", "2024-01-07 00:00:00", "2024-01-13 00:00:00", 0), ("minute", "2024-01-01 10:01:00", "2024-01-01 10:00:59", -1)])
def test_diff_counts_boundaries(spark, unit, a, b, n):
    assert one(spark, d.diff(unit, ts(a), ts(b))) == n


@pytest.mark.parametrize("day, week", [("2024-01-01", 1), ("2024-01-06", 1), ("2024-01-07", 2), ("2023-01-01", 1), ("2023-01-08", 2),
                                       ("2023-12-31", 53)])
def test_week_number(spark, day, week):
    assert one(spark, d.week_number(date(day))) == week


def test_next_named_day(spark):
    # 2024-01-10 is a Wednesday; its week runs from Sunday the 7th
    assert one(spark, d.next_named_day("Monday", date("2024-01-10"))) == dt.date(2024, 1, 15)
    assert one(spark, d.next_named_day("Saturday", date("2024-01-10"))) == dt.date(2024, 1, 20)
    assert one(spark, d.next_named_day("Sunday", date("2024-01-07"))) == dt.date(2024, 1, 21)
    assert one(spark, d.latest_weekday(date("2024-01-10"), 2)) == dt.date(2024, 1, 8)


def test_periods_before_the_start(spark):
    start, length = date("2024-01-10"), F.lit(7)
    assert one(spark, d.period_index(date("2024-01-09"), start, length)) == -1
    assert one(spark, d.period_start(date("2024-01-09"), start, length)) == dt.date(2024, 1, 3)
    assert one(spark, d.return_cutoff(date("2024-01-12"), start, length, F.lit(3))) == dt.date(2024, 1, 10)
    assert one(spark, d.return_cutoff(date("2024-01-11"), start, length, F.lit(3))) == dt.date(2024, 1, 3)


def test_format_duration(spark):
    assert one(spark, d.format_duration(F.lit(93784))) == "26h 03m 04s"


def test_calendar(spark):
    rows = d.month_calendar(spark, 2013, 4).orderBy("week").collect()
    assert len(rows) == 5 and (rows[0].sunday, rows[0].monday, rows[-1].tuesday, rows[-1].wednesday) == (None, 1, 30, None)


def test_spine(spark):
    assert d.date_spine(spark, "2024-02-28", "2024-03-01").count() == 3
    assert d.date_spine(spark, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "1 minute").count() == 61


def test_month_end_clamps(spark):
    assert one(spark, d.dateadd("month", 1, date("2024-01-31"))) == dt.date(2024, 2, 29)


def test_text(spark):
    assert one(spark, x.scrub_phone(F.lit("(801) 555-1512."))) == "801 5551512"
    assert one(spark, x.collapse_spaces(F.lit("a   b  c d"))) == "a b c d"
    assert one(spark, x.stuff(F.lit("abcdef"), 2, 3, "-")) == "a-ef"
    assert one(spark, x.extract_between(F.lit("run (12) of (30)"), "(", ")")) == "12"
    assert one(spark, x.query_param(F.lit("mfstid=395&dropid=54"), "dropid")) == "54"
    assert one(spark, x.query_param(F.lit("xdropid=1"), "dropid")) is None
    assert one(spark, x.first_path_part(F.lit("/c1/drop"))) == "c1"
    assert one(spark, x.kv(F.lit("bad row: acct = 'A7', pub=9"), "acct")) == "A7"
    assert one(spark, x.kv(F.lit("nothing"), "acct")) is None
    assert one(spark, x.text_len(F.lit("ab  "))) == 2
    assert one(spark, x.charindex("x", F.lit("abc"))) == 0
    assert one(spark, x.concat(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(spark, x.token(F.lit("a,b"), ",", 3)) == ""
    assert one(spark, x.sql_literal(F.lit("O'Neil"))) == "'O''Neil'"


def test_split_keeps_empty_parts(spark):
    df = spark.createDataFrame([(1, "a,,b"), (2, None)], "id int, s string")
    assert [(r.pos, r.item) for r in x.split_rows(df, "s", ",").orderBy("pos").collect()] == [(1, "a"), (2, ""), (3, "b")]


def test_values(spark):
    df = spark.createDataFrame([(10, None, 2, 3), (5, -1, None, None)], "draw_amount int, adj_amount int, adj_admin_amount int, ret_amount int")
    assert [r.n for r in df.select(v.net_sales().alias("n")).collect()] == [9, 4]
    assert one(spark, v.int_div(F.lit(-7), F.lit(2))) == -3
    assert one(spark, v.is_numeric(F.lit("1e"))) is False and one(spark, v.is_numeric(F.lit("12.5"))) is True
    assert one(spark, v.is_date(F.lit("2024-02-30"))) is False
    assert one(spark, v.null_safe_ne(F.lit(None).cast("int"), F.lit(-1))) is True
