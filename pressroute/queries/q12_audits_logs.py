"""Audits, logs, transfers, web requests, subscribers and billing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.operators import joins
from pressroute.plans import audits, logs, sales, subscribers
from pressroute.plans.schedules import template_code
from pressroute.queries.q02_filters import NET
from pressroute.queries.q04_aggregates import TEMPLATE
from pressroute.queries.registry import query
from pressroute.sources.frames import DAILY_KEY

DURATION = """CASE WHEN s >= 0 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm '
        || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END"""


@query("returns_audit_wide", "audits daily", f"""
    WITH e AS (SELECT *, CAST(audit_value AS INTEGER) AS v, CAST(audit_value AS INTEGER) - coalesce(lag(CAST(audit_value AS INTEGER)) OVER (
                   PARTITION BY account_id, publication, draw_date ORDER BY audit_id), 0) AS d FROM audits),
    w AS (SELECT account_id, publication, draw_date, count(*) AS entries, string_agg(audit_user_id, ', ' ORDER BY audit_id) AS users,
                 string_agg(v, ', ' ORDER BY audit_id) AS amounts, string_agg(d, ', ' ORDER BY audit_id) AS differences,
                 string_agg(CAST(audit_time AS VARCHAR), ', ' ORDER BY audit_id) AS times FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT w.* REPLACE (CAST(draw_date AS VARCHAR) AS draw_date), draw_amount, {NET} AS net
    FROM w JOIN daily USING (account_id, publication, draw_date)""")
def returns_audit_wide(t):
    """The entries of a draw side by side, as lists of any length."""
    report = audits.returns_audit(t.audits, sales.with_net(t.daily), DAILY_KEY)
    cells = [F.array_join(F.col("entry")[one].cast("array<string>"), ", ").alias(many)
             for one, many in (("user", "users"), ("value", "amounts"), ("difference", "differences"), ("time", "times"))]
    return report.select(*DAILY_KEY, F.col("entries").cast("bigint").alias("entries"), *cells, "draw_amount", "net")


@query("returns_by_owner", "audits daily assignments", f"""
    WITH m AS (SELECT DISTINCT account_id, template_id, d + 1 AS draw_weekday FROM assignments, range(0, 7) AS r(d) WHERE frequency & (1 << CAST(d AS INTEGER)) > 0)
    SELECT {TEMPLATE} AS mfst_code, account_id, publication, CAST(a.draw_date AS VARCHAR) AS draw_date, draw_amount,
           CAST(sum(CASE WHEN audit_user_id = template_id % 6 THEN CAST(audit_value AS INTEGER) END) AS BIGINT) AS owner_returns,
           CAST(sum(CASE WHEN audit_user_id <> template_id % 6 THEN CAST(audit_value AS INTEGER) END) AS BIGINT) AS admin_returns
    FROM audits a JOIN daily USING (account_id, publication, draw_date) JOIN m USING (account_id, draw_weekday) GROUP BY 1, 2, 3, 4, 5""")
def returns_by_owner(t):
    """The owner is the manifest's, found through the weekday mask."""
    items = joins.on_weekday(t.assignments).select("account_id", "draw_weekday", "template_id").distinct()
    manifests = items.withColumns({"mfst_code": template_code(), "owner_id": F.col("template_id") % 6})
    return audits.returns_by_owner(t.audit_events, t.daily.select(*DAILY_KEY, "draw_weekday", "draw_amount"), DAILY_KEY, manifests)


@query("audit_mismatch", "audits daily", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, draw_amount, CAST(audit_value AS INTEGER) AS amount, audit_id, audit_user_id
    FROM (SELECT *, row_number() OVER (PARTITION BY account_id, publication, draw_date ORDER BY audit_id DESC) AS r FROM audits)
    JOIN daily USING (account_id, publication, draw_date) WHERE r = 1 AND draw_amount <> CAST(audit_value AS INTEGER)""")
def audit_mismatch(t):
    return audits.audit_mismatch(t.daily, t.audits, DAILY_KEY, "draw_amount").select(
        *DAILY_KEY, "draw_amount", "amount", "audit_id", "audit_user_id")


@query("decremented_returns", "audits", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, CAST(a.audit_value AS INTEGER) AS first_amount,
           CAST(b.audit_value AS INTEGER) AS second_amount
    FROM audits a JOIN audits b USING (account_id, publication, draw_date)
    WHERE a.audit_id = 1 AND b.audit_id = 2 AND CAST(b.audit_value AS INTEGER) < CAST(a.audit_value AS INTEGER)""")
def decremented_returns(t):
    return audits.decremented(t.audits, DAILY_KEY)


@query("run_durations", "system_log", f"""
    WITH s AS (SELECT group_id, logged_at, row_number() OVER (PARTITION BY group_id ORDER BY logged_at, log_id) AS run FROM system_log WHERE message LIKE 'signup%'),
    e AS (SELECT group_id, logged_at, row_number() OVER (PARTITION BY group_id ORDER BY logged_at, log_id) AS run FROM system_log WHERE message LIKE 'purchase%'),
    p AS (SELECT group_id, run, s.logged_at AS started, e.logged_at AS ended,
          date_diff('second', date_trunc('second', s.logged_at), date_trunc('second', e.logged_at)) AS s FROM s JOIN e USING (group_id, run))
    SELECT group_id, run, CAST(started AS VARCHAR) AS started, CAST(ended AS VARCHAR) AS ended, s AS seconds, {DURATION} AS duration FROM p""")
def run_durations(t):
    return logs.run_durations(t.system_log, "signup%", "purchase%", ["group_id"])


PROCESS_SQL = """SELECT '{name}' AS process, s.group_id, s.log_id, CAST(s.logged_at AS VARCHAR) AS started,
    CAST((SELECT min(e.logged_at) FROM system_log e WHERE e.group_id = s.group_id AND e.message LIKE '{stop}%' AND e.logged_at > s.logged_at) AS VARCHAR) AS stopped
    FROM system_log s WHERE s.message LIKE '{start}%'"""
PARTS = " UNION ALL ".join(PROCESS_SQL.format(name=n, start=a, stop=b)
                           for n, a, b in (("Import", "signup", "purchase"), ("Forecast", "view", "click"), ("IndexMaint", "purchase", "view")))


@query("process_summary", "system_log audits history", f"""
    SELECT *, CASE WHEN stopped IS NULL THEN 'Incomplete' ELSE 'Complete' END AS status FROM ({PARTS})
    UNION ALL SELECT 'DataEntry', NULL, NULL, CAST(slot - INTERVAL 14 MINUTE AS VARCHAR), CAST(slot AS VARCHAR), count(*) || ' Ret/Adj Audit Records'
    FROM (SELECT time_bucket(INTERVAL 15 MINUTE, audit_time) AS slot FROM audits UNION ALL SELECT time_bucket(INTERVAL 15 MINUTE, changed_at) FROM history)
    GROUP BY slot""")
def process_summary(t):
    """Three processes of the log, and data entry over two audit tables."""
    kinds = {"Import": ("signup%", "purchase%"), "Forecast": ("view%", "click%"), "IndexMaint": ("purchase%", "view%")}
    return logs.process_summary(t.system_log, kinds, ["group_id"], [t.audit_events.select("audit_time"), t.history.select("changed_at")])


@query("export_status", "system_log", f"""
    WITH m AS (SELECT group_id, min(logged_at) FILTER (WHERE message LIKE 'signup%') AS b, max(logged_at) FILTER (WHERE message LIKE 'purchase%' OR message LIKE 'click%') AS e,
                      arg_max(CASE WHEN message LIKE 'purchase%' THEN 'SUCCESS' ELSE 'FAILURE' END, (logged_at, log_id))
                          FILTER (WHERE message LIKE 'purchase%' OR message LIKE 'click%') AS status,
                      arg_max(message, logged_at) FILTER (WHERE message LIKE 'view%') AS f FROM system_log GROUP BY group_id),
    q AS (SELECT *, date_diff('second', date_trunc('second', b), date_trunc('second', e)) AS s FROM m)
    SELECT c_custkey AS group_id, c_mktsegment AS export_type, CAST(b AS VARCHAR) AS export_start, CAST(e AS VARCHAR) AS export_end, status,
           {DURATION} AS duration, regexp_extract(f, ': (.*?)\\}}', 1) AS file_no FROM customer LEFT JOIN q ON q.group_id = c_custkey""")
def export_status(t):
    controls = t.table("customer").select(F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("export_type"))
    return logs.export_status(controls, t.system_log)


@query("export_draw_range", "system_log draw_exports", f"""
    WITH m AS (SELECT group_id, min(logged_at) FILTER (WHERE message LIKE 'signup%') AS b, max(logged_at) FILTER (WHERE message LIKE 'purchase%' OR message LIKE 'click%') AS e,
                      arg_max(CASE WHEN message LIKE 'purchase%' THEN 'SUCCESS' ELSE 'FAILURE' END, (logged_at, log_id))
                          FILTER (WHERE message LIKE 'purchase%' OR message LIKE 'click%') AS status FROM system_log GROUP BY group_id),
    x AS (SELECT c_custkey AS group_id, c_mktsegment AS export_type, n_name AS user_name, b, e, status
          FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN m ON group_id = c_custkey),
    d AS (SELECT * FROM draw_exports WHERE draw_date >= (SELECT min(b) FROM x) AND draw_date <= (SELECT max(e) FROM x)),
    p AS (SELECT draw_date, ret_exported_at AS t FROM d UNION ALL SELECT draw_date, adj_exported_at FROM d),
    r AS (SELECT group_id, min(draw_date) AS lo, max(draw_date) AS hi FROM x JOIN p ON t BETWEEN b AND e GROUP BY group_id)
    SELECT group_id, export_type, user_name, CAST(b AS VARCHAR) AS export_start, CAST(e AS VARCHAR) AS export_end, status,
           CAST(lo AS VARCHAR) AS draw_date_min, CAST(hi AS VARCHAR) AS draw_date_max FROM x LEFT JOIN r USING (group_id)""")
def export_draw_range(t):
    """Export runs with user and type, and the first and last date of the draws exported in each."""
    users = t.table("nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("user_name"))
    controls = t.table("customer").select(F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("export_type"), F.col("c_nationkey").alias("user_id"))
    exports = logs.export_status(controls.join(users, "user_id", "left").drop("user_id"), t.system_log).drop("duration", "file_no")
    return logs.export_draw_range(exports, t.draw_exports, "group_id", "draw_date", ["ret_exported_at", "adj_exported_at"])


@query("transfer_times", "transfers", """
    WITH x AS (SELECT transfer_id, mfst_code, drops, date_diff('second', date_trunc('second', dl_start), date_trunc('second', dl_end)) AS dl_seconds,
        date_diff('second', date_trunc('second', ul_start), date_trunc('second', ul_end)) AS ul_seconds FROM transfers)
    SELECT *, drops * 3 AS expected, CAST(ul_seconds - drops * 3 > 60 AS INTEGER) AS slow FROM x WHERE ul_seconds IS NOT NULL""")
def transfer_times(t):
    return logs.transfer_times(t.transfers).select("transfer_id", "mfst_code", "drops", "dl_seconds", "ul_seconds", "expected", "slow")


@query("slow_transfer_share", "transfers", """
    WITH x AS (SELECT mfst_code, drops, date_diff('second', date_trunc('second', ul_start), date_trunc('second', ul_end)) AS s FROM transfers)
    SELECT mfst_code, count(*) AS uploads, count(*) FILTER (WHERE s - drops * 3 > 60) AS slow,
           round(CAST(count(*) FILTER (WHERE s - drops * 3 > 60) AS DOUBLE) / count(*) * 100, 3) AS percent FROM x WHERE s IS NOT NULL GROUP BY mfst_code""")
def slow_transfer_share(t):
    return logs.transfer_times(t.transfers).groupBy("mfst_code").agg(
        F.count(F.lit(1)).alias("uploads"), F.sum("slow").alias("slow"),
        F.round(F.sum("slow").cast("double") / F.count(F.lit(1)) * 100, 3).alias("percent"))


@query("transfer_state", "transfers", """
    WITH x AS (SELECT transfer_id, CASE WHEN dl_start IS NULL AND dl_end IS NULL AND ul_start IS NULL AND ul_end IS NULL THEN 7
        WHEN dl_start IS NOT NULL AND dl_end IS NULL AND ul_start IS NULL AND ul_end IS NULL THEN 10
        WHEN dl_start IS NOT NULL AND dl_end IS NOT NULL AND ul_start IS NULL AND ul_end IS NULL THEN 11
        WHEN dl_start IS NOT NULL AND dl_end IS NOT NULL AND ul_start IS NOT NULL AND ul_end IS NULL THEN 12
        WHEN dl_start IS NOT NULL AND dl_end IS NOT NULL AND ul_start IS NOT NULL AND ul_end IS NOT NULL THEN 13 END AS state_id FROM transfers)
    SELECT transfer_id, state_id, CASE state_id WHEN 7 THEN 'Cancelled' WHEN 10 THEN 'Downloading' WHEN 11 THEN 'Downloaded'
        WHEN 12 THEN 'Uploading' WHEN 13 THEN 'Uploaded' END AS state FROM x""")
def transfer_state(t):
    return logs.transfer_state(t.transfers).select("transfer_id", "state_id", "state")


@query("duplicate_requests", "weblog", """
    WITH r AS (SELECT logged_at, page, regexp_extract(query, 'mfstid=([0-9]+)', 1) AS mfst_id, regexp_extract(query, 'dropid=([0-9]+)', 1) AS drop_id,
                      split_part(page, '/', 2) AS company FROM weblog),
    a AS (SELECT mfst_id, company, min(logged_at) AS acked_at FROM r WHERE page LIKE '%/ack' GROUP BY 1, 2)
    SELECT company, mfst_id, drop_id, count(*) AS requests FROM r JOIN a USING (mfst_id, company)
    WHERE page LIKE '%/drop' AND logged_at < acked_at GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicate_requests(t):
    return logs.dup_requests(t.weblog)


@query("merge_timelines", "weblog system_log", """
    SELECT CAST(logged_at AS VARCHAR) AS logged_at, 'web' AS origin, page || '?' || query AS line FROM weblog
    UNION ALL SELECT CAST(logged_at + INTERVAL 1 HOUR AS VARCHAR), 'log', message FROM system_log ORDER BY 1, 2, 3""")
def merge_timelines(t):
    web = t.weblog.withColumn("line", F.concat("page", F.lit("?"), "query"))
    log = t.system_log.withColumn("line", F.col("message")).withColumn("logged_at", F.col("logged_at") + F.expr("interval 1 hour"))
    return logs.timeline(("web", web), ("log", log))


@query("subscribers_by_plan", "subscriptions", """
    WITH s AS (SELECT *, cancelled IS NULL AS active, subscriber_plan_id % 3 = 0 AS linked FROM subscriptions),
    live AS (SELECT DISTINCT user_id FROM s WHERE active AND expires > DATE '2001-03-31'),
    confirmed AS (SELECT user_id FROM s GROUP BY user_id HAVING count(*) FILTER (WHERE plan_id NOT IN (1, 2) AND NOT linked) > 0 AND count(*) FILTER (WHERE NOT active) > 0)
    SELECT user_id, subscriber_plan_id, plan_id, CAST(purchase_date AS VARCHAR) AS purchase_date, 'nation=' || c_nationkey || '; segment=' || c_mktsegment AS fields
    FROM s JOIN live USING (user_id) LEFT JOIN customer ON c_custkey = user_id
    WHERE purchase_date BETWEEN DATE '1995-01-01' AND DATE '2001-03-31' AND plan_id NOT IN (1, 2)
      AND (NOT active OR user_id NOT IN (SELECT user_id FROM confirmed))""")
def subscribers_by_plan(t):
    """A row per purchased plan; a linked plan is one whose name begins with a star, here every third."""
    plans = t.subscriptions.withColumns({"active": F.col("cancelled").isNull(), "linked": F.col("subscriber_plan_id") % 3 == 0})
    keys = t.table("customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    fields = keys.unpivot(["user_id"], ["segment", "nation"], "field", "value")
    return subscribers.active_subs(plans, fields, "1995-01-01", "2001-03-31", [1, 2]).select(
        "user_id", "subscriber_plan_id", "plan_id", "purchase_date", "fields")


@query("message_status", "system_log", """
    SELECT CAST(CAST(logged_at AS DATE) AS VARCHAR) AS day, split_part(message, ' ', 1) AS status, count(*) AS messages FROM system_log GROUP BY 1, 2""")
def message_status(t):
    return logs.message_status(t.system_log.withColumn("status", F.split_part("message", F.lit(" "), F.lit(1))))


@query("billing_period", "manifests", """
    SELECT week + 1 AS period_id, CAST(DATE '1995-01-01' + CAST(week * 7 + 7 AS INTEGER) AS VARCHAR) AS begin_date,
           CAST(DATE '1995-01-01' + CAST(week * 7 + 13 AS INTEGER) AS VARCHAR) AS end_date,
           CAST(DATE '1995-01-01' + CAST(week * 7 + 15 AS INTEGER) AS VARCHAR) AS cutoff_date, 0 AS status
    FROM (SELECT max((manifest_date - DATE '1995-01-01') // 7) AS week FROM manifests)""")
def billing_period(t):
    """Periods are the weeks on file; the next one follows the last."""
    week = F.floor(F.datediff("manifest_date", F.lit("1995-01-01").cast("date")) / 7)
    begin = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("period_id") * 7).cast("int"))
    periods = t.manifests.select(week.alias("period_id")).distinct().select(
        "period_id", begin.alias("begin_date"), F.date_add(begin, 6).alias("end_date"), F.date_add(begin, 8).alias("cutoff_date"))
    return subscribers.next_period(periods)
