"""Date and time functions over the orders, the events and the assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions import bits, dates as d
from pressroute.functions.bits import DAY_CODES, DAY_NAMES
from pressroute.queries.registry import query

AS_OF = "2002-01-09"
DAY_LIST = """(SELECT string_agg(name, ', ' ORDER BY i) FROM (VALUES (0, 'SUN'), (1, 'MON'), (2, 'TUE'), (3, 'WED'),
        (4, 'THU'), (5, 'FRI'), (6, 'SAT')) AS dd(i, name) WHERE {f} & (1 << i) > 0)"""
JAN1 = "date_trunc('year', day)"


def _day(t):
    return t.manifests.select("manifest_id", F.col("manifest_date").alias("day"))


DAY_SQL = "WITH o AS (SELECT manifest_id, manifest_date AS day FROM manifests) "


@query("date_add", "system_log", """
    SELECT log_id, CAST(CAST(logged_at AS DATE) + 10 AS VARCHAR) AS plus_days, CAST(CAST(logged_at AS DATE) - 14 AS VARCHAR) AS less_weeks,
           CAST(CAST(CAST(logged_at AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month,
           CAST(logged_at + INTERVAL 90 MINUTE AS VARCHAR) AS plus_minutes, CAST(logged_at - INTERVAL 30 SECOND AS VARCHAR) AS less_seconds
    FROM system_log""")
def date_add(t):
    ts = "logged_at"
    return t.system_log.select(
        "log_id", d.dateadd("day", 10, ts).alias("plus_days"), d.dateadd("week", -2, ts).alias("less_weeks"),
        d.dateadd("month", 1, ts).alias("next_month"), d.dateadd("minute", 90, ts).alias("plus_minutes"),
        d.dateadd("second", -30, ts).alias("less_seconds"))


@query("date_diff", "transfers", """
    SELECT transfer_id, date_diff('day', CAST(dl_start AS DATE), CAST(ul_end AS DATE)) AS days,
           date_diff('hour', date_trunc('hour', dl_start), date_trunc('hour', ul_end)) AS hours,
           date_diff('minute', date_trunc('minute', dl_start), date_trunc('minute', ul_end)) AS minutes,
           date_diff('second', date_trunc('second', dl_start), date_trunc('second', ul_end)) AS seconds,
           CAST(floor((CAST(ul_end AS DATE) - DATE '1970-01-04') / 7) - floor((CAST(dl_start AS DATE) - DATE '1970-01-04') / 7) AS INTEGER) AS weeks,
           (extract(year FROM ul_end) - extract(year FROM dl_start)) * 12 + extract(month FROM ul_end) - extract(month FROM dl_start) AS months
    FROM transfers""")
def date_diff(t):
    return t.transfers.select("transfer_id", *[
        d.diff(u, "dl_start", "ul_end").alias(f"{u}s") for u in ("day", "hour", "minute", "second", "week", "month")])


@query("date_part", "manifests", DAY_SQL + f"""
    SELECT manifest_id, CAST(extract(dow FROM day) + 1 AS INTEGER) AS weekday, dayname(day) AS day_name,
           CAST(extract(day FROM day) AS INTEGER) AS day_of_month, CAST(extract(month FROM day) AS INTEGER) AS month,
           CAST(extract(year FROM day) AS INTEGER) AS year,
           CAST((extract(doy FROM day) + extract(dow FROM {JAN1}) - 1) // 7 + 1 AS INTEGER) AS week FROM o""")
def date_part(t):
    return _day(t).select("manifest_id", F.dayofweek("day").alias("weekday"), d.day_name("day").alias("day_name"),
                          F.dayofmonth("day").alias("day_of_month"), F.month("day").alias("month"), F.year("day").alias("year"),
                          d.week_number("day").alias("week"))


@query("date_format", "system_log", """
    SELECT log_id, strftime(logged_at, '%m/%d/%y') AS s1, strftime(logged_at, '%m/%d/%Y') AS s101, strftime(logged_at, '%H:%M:%S') AS s108,
           strftime(logged_at, '%H:%M:%S') || ':' || strftime(logged_at, '%g') AS s114,
           strftime(logged_at, '%Y-%m-%d %H:%M:%S') || '.' || strftime(logged_at, '%g') AS s121,
           strftime(logged_at, '%b %d %Y %I:%M%p') AS s0 FROM system_log""")
def date_format(t):
    return t.system_log.select("log_id", *[d.convert_date("logged_at", s).alias(f"s{s}") for s in (1, 101, 108, 114, 121, 0)])


@query("date_parse", "system_log", """
    SELECT log_id, CASE WHEN log_id % 10 <> 3 THEN CAST(date_trunc('second', logged_at) AS VARCHAR) END AS parsed FROM system_log""")
def date_parse(t):
    """Times cut out of a text line; a broken one gives null."""
    stamp = F.date_format("logged_at", "yyyyMMdd HHmmss")
    line = F.concat(F.lit("export_"), F.when(F.col("log_id") % 10 == 3, F.lit("20249999 000000")).otherwise(stamp))
    return t.system_log.select("log_id", d.to_datetime(F.substring(line, 8, 15), "yyyyMMdd HHmmss").alias("parsed"))


@query("date_now", "manifests", f"""
    SELECT manifest_id, DATE '{AS_OF}' - manifest_date AS age FROM manifests""")
def date_now(t):
    """Age against an explicit date: no report reads the clock."""
    return t.manifests.select("manifest_id", d.diff("day", "manifest_date", F.lit(AS_OF).cast("date")).alias("age"))


@query("date_trunc_units", "system_log", """
    SELECT CAST(date_trunc('hour', logged_at) AS VARCHAR) AS hour, CAST(date_trunc('hour', logged_at) + INTERVAL 1 HOUR AS VARCHAR) AS hour_end,
           count(*) AS n, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, logged_at)) AS quarters FROM system_log GROUP BY 1, 2""")
def date_trunc_units(t):
    return t.system_log.groupBy(d.trunc("logged_at", "hour").alias("hour"), d.next_boundary("logged_at", "hour").alias("hour_end")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(d.slot_start("logged_at", 15)).alias("quarters"))


@query("next_weekday", "manifests", DAY_SQL + """
    SELECT manifest_id, CAST(day - CAST(extract(dow FROM day) AS INTEGER) + 1 + 7 AS VARCHAR) AS next_monday,
           CAST(day - CAST(extract(dow FROM day) AS INTEGER) + 1 + 12 AS VARCHAR) AS next_saturday,
           CAST(day - CAST(extract(dow FROM day) AS INTEGER) + 1 + 13 AS VARCHAR) AS next_sunday,
           CAST(day - CAST((extract(dow FROM day) + 6) % 7 AS INTEGER) AS VARCHAR) AS last_monday FROM o""")
def next_weekday(t):
    return _day(t).select("manifest_id", *[d.next_named_day(n, "day").alias(f"next_{n.lower()}") for n in ("Monday", "Saturday", "Sunday")],
                          d.latest_weekday("day", 2).alias("last_monday"))


@query("day_bit", "manifests", DAY_SQL + """
    SELECT 1 << CAST(extract(dow FROM day) AS INTEGER) AS bit, count(*) AS n FROM o GROUP BY 1""")
def day_bit(t):
    return _day(t).groupBy(bits.day_bit("day").alias("bit")).agg(F.count(F.lit(1)).alias("n"))


@query("day_list", "assignments", f"""
    SELECT account_id, brand_no, sequence_id, frequency, {DAY_LIST.format(f="a.frequency")} AS day_list FROM assignments a""")
def day_list(t):
    return t.assignments.select("account_id", "brand_no", "sequence_id", "frequency", bits.day_list("frequency").alias("day_list"))


@query("day_flags", "assignments", f"""
    SELECT account_id, brand_no, sequence_id,
           {", ".join(f"CASE WHEN frequency & {1 << i} > 0 THEN ' X ' ELSE ' - ' END AS {c.lower()}" for i, c in enumerate(DAY_CODES))}
    FROM assignments""")
def day_flags(t):
    return t.assignments.select("account_id", "brand_no", "sequence_id", *bits.day_flags("frequency"))


@query("frequency_catalogue", "assignments", f"""
    WITH masks AS (SELECT CAST(m AS INTEGER) AS frequency FROM range(1, 127) AS r(m)),
    named AS (SELECT frequency, {DAY_LIST.format(f="masks.frequency")} AS day_list,
              CASE {" ".join(f"WHEN frequency & {1 << i} > 0 THEN {i + 1}" for i in range(7))} END AS first_day FROM masks)
    SELECT frequency, day_list, row_number() OVER (ORDER BY length(day_list), first_day, frequency) AS sort_order, coalesce(items, 0) AS items
    FROM named LEFT JOIN (SELECT frequency, count(*) AS items FROM assignments GROUP BY frequency) USING (frequency)""")
def frequency_catalogue(t):
    """All masks, with how many assignments use each."""
    used = t.assignments.groupBy("frequency").agg(F.count(F.lit(1)).alias("items"))
    return bits.frequency_catalogue(t.spark).join(used, "frequency", "left").select(
        "frequency", "day_list", "sort_order", F.coalesce("items", F.lit(0)).alias("items"))


@query("format_duration", "transfers", """
    SELECT transfer_id, (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' AS duration
    FROM (SELECT transfer_id, date_diff('second', date_trunc('second', dl_start), date_trunc('second', ul_end)) AS s FROM transfers) WHERE s IS NOT NULL""")
def format_duration(t):
    s = d.diff("second", "dl_start", "ul_end")
    return t.transfers.where(s.isNotNull()).select("transfer_id", d.format_duration(s).alias("duration"))


@query("tz_offset", "system_log", "SELECT log_id, CAST(logged_at - INTERVAL 5 HOUR AS VARCHAR) AS company_time FROM system_log")
def tz_offset(t):
    return t.system_log.select("log_id", d.shift_hours("logged_at", -5).alias("company_time"))


@query("month_calendar", "manifests", f"""
    WITH o AS (SELECT manifest_date AS day FROM manifests),
    w AS (SELECT CAST(extract(year FROM day) AS INTEGER) AS year, CAST(extract(month FROM day) AS INTEGER) AS month,
          CAST((extract(doy FROM day) + extract(dow FROM {JAN1}) - 1) // 7 + 1 AS INTEGER) AS week,
          extract(dow FROM day) AS dow, CAST(extract(day FROM day) AS INTEGER) AS dom FROM o)
    SELECT year, month, week, {", ".join(f"min(CASE WHEN dow = {i} THEN dom END) AS {n.lower()}" for i, n in enumerate(DAY_NAMES))}
    FROM w GROUP BY year, month, week""")
def month_calendar(t):
    """Calendar grid of every month that has a manifest."""
    return d.calendar_grid(t.manifests, "manifest_date")


@query("period_start", "manifests", DAY_SQL + """
    , p AS (SELECT manifest_id, day, CAST(floor((day - DATE '1996-05-06') / 28) AS INTEGER) AS idx FROM o)
    SELECT manifest_id, idx, CAST(DATE '1996-05-06' + idx * 28 AS VARCHAR) AS period_start,
           CAST(DATE '1996-05-06' + idx * 28 - CASE WHEN day - (DATE '1996-05-06' + idx * 28) + 1 >= 10 THEN 0 ELSE 28 END AS VARCHAR) AS cutoff FROM p""")
def period_start(t):
    """Four-week periods from a fixed start, dates before the start included."""
    start, length = F.lit("1996-05-06").cast("date"), F.lit(28)
    return _day(t).select("manifest_id", d.period_index("day", start, length).alias("idx"),
                          d.period_start("day", start, length).alias("period_start"),
                          d.return_cutoff("day", start, length, F.lit(10)).alias("cutoff"))


@query("shift_demo_dates", "manifests", DAY_SQL + f"""
    SELECT manifest_id, CAST(day + CAST(floor((DATE '{AS_OF}' - day) / 7) AS INTEGER) * 7 AS VARCHAR) AS shifted,
           CAST(CAST(CASE WHEN day + to_months(CAST(m AS INTEGER)) > DATE '{AS_OF}' + 1 THEN (day + to_months(CAST(m AS INTEGER))) - INTERVAL 1 MONTH
                     ELSE day + to_months(CAST(m AS INTEGER)) END AS DATE) AS VARCHAR) AS by_month
    FROM (SELECT *, (2002 - extract(year FROM day)) * 12 + 1 - extract(month FROM day) AS m FROM o)""")
def shift_demo_dates(t):
    """Dates moved up to a given day by whole weeks, and by whole months stepped back when past it."""
    as_of = F.lit(AS_OF).cast("date")
    moved = F.add_months("day", d.diff("month", "day", as_of))
    by_month = F.when(moved > F.date_add(as_of, 1), F.add_months(moved, -1)).otherwise(moved)
    return _day(t).select("manifest_id", d.roll_forward("day", as_of).alias("shifted"), by_month.alias("by_month"))
