"""Row numbers, versions and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.operators import ordered
from pressroute.plans import audits as audit_plans
from pressroute.queries.registry import query
from pressroute.sources.frames import DAILY_KEY


@query("row_number_global", "", """
    SELECT p_partkey AS publication_id, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM part""")
def row_number_global(t):
    """One numbering of the whole table, made in ranges of the full sort key."""
    rows = t.publications.select("print_sort_order", "publication_id")
    return ordered.numbered_overall(rows, ["print_sort_order", "publication_id"], "position").select("publication_id", "position")


@query("row_number_partition", "", """
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events""")
def row_number_partition(t):
    rows = t.table("events").select("user_id", "ts", "event_id")
    return ordered.numbered(rows, ["user_id"], ["ts", "event_id"], ordered.ranges(rows, "ts"), "position").select(
        "event_id", "position")


@query("resequence", "assignments", """
    SELECT sequence_id, account_id, brand_no,
           100 + 10 * row_number() OVER (PARTITION BY sequence_id ORDER BY sequence, account_id, brand_no) AS new_sequence FROM assignments""")
def resequence(t):
    return ordered.resequence(t.assignments, ["sequence_id"], ["sequence", "account_id", "brand_no"],
                              ordered.ranges(t.assignments, "sequence"), 100, 10).select("sequence_id", "account_id", "brand_no", "new_sequence")


@query("id_from_max", "publications accounts", """
    SELECT pub_type || ' ' || pub_short_name AS category,
           (SELECT max(account_id) FROM accounts) + row_number() OVER (ORDER BY pub_type || ' ' || pub_short_name) AS category_id
    FROM (SELECT DISTINCT pub_type, pub_short_name FROM publications)""")
def id_from_max(t):
    new = t.publications.select(F.concat("pub_type", F.lit(" "), "pub_short_name").alias("category")).distinct()
    return ordered.assign_ids(new, t.accounts.agg(F.max("account_id")), ["category"], "category_id")


@query("per_group_next_id", "audits daily", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(top, 0) + 1 AS next_version
    FROM daily LEFT JOIN (SELECT account_id, publication, draw_date, max(audit_id) AS top FROM audits GROUP BY 1, 2, 3)
      USING (account_id, publication, draw_date)""")
def per_group_next_id(t):
    return ordered.next_version(t.daily, t.audits, DAILY_KEY, "audit_id").select(*DAILY_KEY, "next_version")


@query("latest_by_max_time", "history", """
    SELECT history_id, account_id, publication, CAST(changed_at AS VARCHAR) AS changed_at, new_draw FROM (
        SELECT *, rank() OVER (PARTITION BY account_id, publication ORDER BY changed_at DESC) AS r FROM history) WHERE r = 1""")
def latest_by_max_time(t):
    return ordered.latest_with_ties(t.history, ["account_id", "publication"], "changed_at").select(
        "history_id", "account_id", "publication", "changed_at", "new_draw")


@query("latest_by_max_id", "audits", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, audit_id, audit_value FROM (
        SELECT *, row_number() OVER (PARTITION BY account_id, publication, draw_date ORDER BY audit_id DESC) AS r FROM audits) WHERE r = 1""")
def latest_by_max_id(t):
    return ordered.latest(t.audits.select(*DAILY_KEY, "audit_id", "audit_value"), DAILY_KEY, "audit_id")


@query("earliest_after", "history", """
    SELECT account_id, publication, CAST(changed_at AS VARCHAR) AS changed_at, old_draw FROM (
        SELECT *, row_number() OVER (PARTITION BY account_id, publication ORDER BY changed_at, history_id) AS r
        FROM history WHERE changed_at > TIMESTAMP '2024-01-10 12:00:00') WHERE r = 1""")
def earliest_after(t):
    """First change of each account and publication after an export time."""
    later = t.history.where(F.col("changed_at") > F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
    rows = later.select("account_id", "publication", F.struct("changed_at", "history_id").alias("at"), "old_draw")
    return ordered.earliest(rows, ["account_id", "publication"], "at").select(
        "account_id", "publication", F.col("at.changed_at").alias("changed_at"), "old_draw")


@query("first_last_version", "audits", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, count(*) AS versions,
           CAST(arg_min(audit_value, audit_id) AS INTEGER) AS first_amount, CAST(arg_max(audit_value, audit_id) AS INTEGER) AS last_amount,
           arg_min(audit_user_id, audit_id) AS first_audit_user_id, arg_max(audit_user_id, audit_id) AS last_audit_user_id
    FROM audits GROUP BY 1, 2, 3 HAVING count(*) = 2""")
def first_last_version(t):
    return audit_plans.multiple_returns(t.audits, DAILY_KEY)


@query("last_nonzero", "daily", """
    SELECT account_id, publication, CAST(max(CASE WHEN draw_amount > 0 THEN draw_date END) AS VARCHAR) AS last_nonzero
    FROM daily GROUP BY account_id, publication""")
def last_nonzero(t):
    return ordered.last_nonzero(t.daily, ["account_id", "publication"], "draw_amount", "draw_date")


@query("version_delta", "audits", """
    SELECT event_id, CAST(audit_value AS INTEGER) - lag(CAST(audit_value AS INTEGER)) OVER (
        PARTITION BY account_id, publication ORDER BY audit_time, event_id) AS delta FROM audits""")
def version_delta(t):
    """Difference to the entry before, across days, for accounts with any number of entries."""
    rows = t.audit_events.withColumn("amount", F.col("audit_value").cast("int"))
    out = ordered.previous(rows, ["account_id", "publication"], ["audit_time", "event_id"], "amount", ordered.ranges(rows, "audit_time"))
    return out.select("event_id", (F.col("amount") - F.col("prev")).alias("delta"))


@query("gap_between_rows", "", """
    SELECT event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS seconds FROM events""")
def gap_between_rows(t):
    rows = t.table("events").select("user_id", "ts", "event_id")
    out = ordered.previous(rows, ["user_id"], ["ts", "event_id"], "ts", ordered.ranges(rows, "ts"), "before")
    return out.select("event_id", F.timestamp_diff(
        "SECOND", F.date_trunc("second", "before"), F.date_trunc("second", "ts")).alias("seconds"))


@query("group_spread_fix", "assignments", """
    SELECT sequence_id, account_id, brand_no, sequence AS old_sequence,
           min(sequence) OVER (PARTITION BY sequence_id, account_id) AS sequence FROM assignments""")
def group_spread_fix(t):
    return ordered.align_to_group(t.assignments, ["sequence_id", "account_id"], "sequence", "min").select(
        "sequence_id", "account_id", "brand_no", "old_sequence", "sequence")


@query("identity_rank", "system_log", """
    SELECT log_id, row_number() OVER (ORDER BY logged_at, log_id) AS run FROM system_log WHERE message LIKE 'signup%'""")
def identity_rank(t):
    rows = t.system_log.where(F.col("message").like("signup%")).select("logged_at", "log_id")
    return ordered.numbered_overall(rows, ["logged_at", "log_id"], "run").select("log_id", "run")
