"""Further reports and maintenance jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.bits import DAY_CODES
from pressroute.functions.dates import date_spine, day_name, next_boundary
from pressroute.operators import joins, sets
from pressroute.plans import audits, logs, sales, schedules, thresholds
from pressroute.queries.q02_filters import NET
from pressroute.queries.q04_aggregates import TEMPLATE
from pressroute.queries.q11_schedules import AS_OF, DAYS, PUB_RULES, _rules
from pressroute.queries.registry import query
from pressroute.sources.frames import DAILY_KEY, DRAW_KEY


@query("manifest_report_by_account", "assignments", f"""
    SELECT account_id, max(CASE WHEN manifest_type_id = 1 AND frequency & 62 > 0 THEN {TEMPLATE} END) AS daily,
           max(CASE WHEN manifest_type_id = 1 AND frequency & 64 > 0 THEN {TEMPLATE} END) AS sat,
           max(CASE WHEN manifest_type_id = 1 AND frequency & 1 > 0 THEN {TEMPLATE} END) AS sun,
           max(CASE WHEN manifest_type_id IN (2, 4) THEN {TEMPLATE} END) AS returns FROM assignments GROUP BY account_id""")
def manifest_report_by_account(t):
    return schedules.report_by_account(t.assignments)


@query("not_allowing_forecasting", "account_pubs accounts default_draws", """
    SELECT account_id, publication_id, CAST(sum(allow_forecasting) AS BIGINT) AS days_allowed FROM account_pubs ap JOIN accounts a USING (account_id)
    JOIN default_draws USING (account_id, publication_id) WHERE ap.active = 1 AND a.active = 1
    GROUP BY account_id, publication_id HAVING sum(allow_forecasting) < 7""")
def not_allowing_forecasting(t):
    live = t.account_pubs.where("active = 1").join(t.accounts.where("active = 1").select("account_id"), "account_id", "left_semi")
    days = t.default_draws.groupBy("account_id", "publication_id").agg(F.sum("allow_forecasting").alias("days_allowed")).where("days_allowed < 7")
    return joins.semi(days, live, ["account_id", "publication_id"])


@query("split_across_manifests", "assignments", """
    SELECT account_id, manifest_type_id, count(DISTINCT template_id) AS manifests FROM assignments
    GROUP BY account_id, manifest_type_id HAVING count(DISTINCT template_id) > 1""")
def split_across_manifests(t):
    return schedules.split_accounts(t.assignments)


@query("big_manifests", "assignments", """
    SELECT template_id, sequence_id, count(*) AS drops FROM assignments GROUP BY template_id, sequence_id ORDER BY drops DESC, sequence_id""")
def big_manifests(t):
    return schedules.drop_counts(t.assignments).orderBy(F.desc("drops"), "sequence_id")


@query("multiple_draw_changes", "history", """
    SELECT history_id, old_draw, new_draw, changes FROM (SELECT *, count(*) OVER (PARTITION BY account_id, publication, draw_date) AS changes FROM history)
    WHERE changes > 1""")
def multiple_draw_changes(t):
    return audits.multiple_changes(t.history, DAILY_KEY).select("history_id", "old_draw", "new_draw", "changes")


@query("change_types_by_account", "history", """
    SELECT account_id, change_type_id, count(*) AS changes, CAST(sum(new_draw - old_draw) AS BIGINT) AS net_change FROM history GROUP BY 1, 2""")
def change_types_by_account(t):
    return t.history.groupBy("account_id", "change_type_id").agg(
        F.count(F.lit(1)).alias("changes"), F.sum(F.col("new_draw") - F.col("old_draw")).alias("net_change"))


@query("inactive_with_draw", "account_pubs accounts default_draws", f"""
    SELECT account_id, publication_id, CASE draw_weekday {" ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(DAY_CODES))} END AS day,
           draw_amount, a.active AS account_active, ap.active AS pair_active
    FROM account_pubs ap JOIN accounts a USING (account_id) JOIN default_draws USING (account_id, publication_id)
    WHERE (a.active = 0 OR ap.active = 0) AND draw_amount > 0""")
def inactive_with_draw(t):
    day = F.element_at(F.array(*[F.lit(c) for c in DAY_CODES]), F.col("draw_weekday"))
    idle = (t.account_pubs.select("account_id", "publication_id", F.col("active").alias("pair_active"))
            .join(t.accounts.select("account_id", F.col("active").alias("account_active")), "account_id")
            .where("pair_active = 0 or account_active = 0"))
    return idle.join(t.default_draws.where("draw_amount > 0"), ["account_id", "publication_id"]).select(
        "account_id", "publication_id", day.alias("day"), "draw_amount", "account_active", "pair_active")


@query("orphaned_defaults", "account_pubs default_draws", """
    SELECT account_id, publication_id, draw_weekday, draw_amount FROM default_draws d
    WHERE NOT EXISTS (SELECT 1 FROM account_pubs p WHERE p.account_id = d.account_id AND p.publication_id = d.publication_id AND p.active = 1)""")
def orphaned_defaults(t):
    return joins.anti(t.default_draws, t.account_pubs.where("active = 1"), ["account_id", "publication_id"]).select(
        "account_id", "publication_id", "draw_weekday", "draw_amount")


@query("compare_sequences_by_day", "assignments", f"""
    WITH {DAYS} SELECT template_id, account_id, brand_no, max(CASE WHEN weekday = 2 THEN sequence END) AS first_place,
           max(CASE WHEN weekday = 4 THEN sequence END) AS second_place FROM days WHERE weekday IN (2, 4) GROUP BY 1, 2, 3""")
def compare_sequences_by_day(t):
    return schedules.compare_days(t.assignments, 2, 4)


@query("manifests_by_weekday", "assignments", f"""
    WITH {DAYS} SELECT account_id, brand_no, manifest_type_id,
           {", ".join(f"max(CASE WHEN weekday = {i + 1} THEN {TEMPLATE} END) AS {c.lower()}" for i, c in enumerate(DAY_CODES))} FROM days GROUP BY 1, 2, 3""")
def manifests_by_weekday(t):
    return schedules.manifests_by_weekday(t.assignments)


@query("not_all_pubs_assigned", "assignments draw_lines publications", """
    WITH a AS (SELECT account_id, frequency, count(*) AS assigned FROM assignments WHERE manifest_type_id = 1 GROUP BY 1, 2),
    p AS (SELECT account_id, count(DISTINCT brand_no) AS taken FROM draw_lines JOIN publications USING (publication_id) GROUP BY 1)
    SELECT account_id, frequency, assigned, taken FROM a JOIN p USING (account_id) WHERE assigned < taken""")
def not_all_pubs_assigned(t):
    return schedules.not_all_assigned(t.assignments, t.account_brands)


@query("manifest_history", "assignments dated_manifests", f"""
    WITH {DAYS} SELECT template_id, account_id, brand_no, CAST(min(manifest_date) AS VARCHAR) AS first_date,
           CAST(max(manifest_date) AS VARCHAR) AS last_date, count(DISTINCT manifest_date) AS manifests
    FROM days d JOIN dated_manifests m USING (template_id) WHERE m.draw_weekday = d.weekday GROUP BY 1, 2, 3""")
def manifest_history(t):
    return schedules.manifest_history(t.assignments, t.dated_manifests)


@query("publication_start_date", "draw_lines", """
    SELECT account_id, publication_id, CAST(min(draw_date) AS VARCHAR) AS first_draw FROM draw_lines GROUP BY 1, 2""")
def publication_start_date(t):
    return t.draw_lines.groupBy("account_id", "publication_id").agg(F.min("draw_date").alias("first_draw"))


@query("draw_date_delivery_date", "draws", """
    SELECT dayname(draw_date) AS draw_day, dayname(delivery_date) AS delivery_day, delivery_date - draw_date AS days_later, count(*) AS n
    FROM draws GROUP BY 1, 2, 3""")
def draw_date_delivery_date(t):
    return t.draws.groupBy(day_name("draw_date").alias("draw_day"), day_name("delivery_date").alias("delivery_day"),
                           F.datediff("delivery_date", "draw_date").alias("days_later")).agg(F.count(F.lit(1)).alias("n"))


@query("exported_returns", "draws publications", """
    SELECT pub_short_name, CAST(draw_date AS VARCHAR) AS draw_date, CAST(sum(coalesce(ret_export_last, 0)) AS BIGINT) AS exported,
           count(*) FILTER (WHERE ret_amount IS NOT NULL AND ret_export_last IS NULL) AS never_exported
    FROM draws JOIN publications USING (publication_id) GROUP BY 1, 2""")
def exported_returns(t):
    open_rows = F.col("ret_amount").isNotNull() & F.col("ret_export_last").isNull()
    return t.draws.join(t.publications.select("publication_id", "pub_short_name"), "publication_id").groupBy(
        "pub_short_name", "draw_date").agg(F.sum(F.coalesce("ret_export_last", F.lit(0))).alias("exported"),
                                           F.count_if(open_rows).alias("never_exported"))


@query("entries_by_hour", "audits", """
    SELECT CAST(date_trunc('hour', audit_time) + INTERVAL 1 HOUR AS VARCHAR) AS until, count(*) AS entries FROM audits GROUP BY 1""")
def entries_by_hour(t):
    """Labelled by the end of the hour."""
    return t.audit_events.groupBy(next_boundary("audit_time", "hour").alias("until")).agg(F.count(F.lit(1)).alias("entries"))


@query("returns_per_minute", "system_log", """
    SELECT CAST(m AS VARCHAR) AS minute, coalesce(n, 0) AS entries
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 MINUTE)) AS m)
    LEFT JOIN (SELECT date_trunc('minute', logged_at) AS m, count(*) AS n FROM system_log GROUP BY 1) USING (m)""")
def returns_per_minute(t):
    return logs.per_minute(t.system_log, date_spine(t.spark, "2024-01-01 00:00:00", "2024-01-31 00:00:00", "1 minute", "minute"))


@query("thresholds_over_range", "publications", f"""
    WITH pr AS ({PUB_RULES}), d AS (SELECT pr.*, DATE '{AS_OF}' - CAST(n AS INTEGER) AS day FROM pr, range(0, 42) AS r(n)),
    s AS (SELECT *, period_start_date + CAST(floor((day - period_start_date) / period_length) AS INTEGER) * period_length AS cps FROM d)
    SELECT publication_id, CAST(day AS VARCHAR) AS day,
           CAST(CASE WHEN day - cps + 1 >= cutoff_day THEN cps ELSE cps - period_length END AS VARCHAR) AS min_date FROM s""")
def thresholds_over_range(t):
    return thresholds.cutoffs_over_range(_rules(t)[1], "publication_id", AS_OF)


@query("set_forecast_min", "default_draws accounts", """
    SELECT account_id, publication_id, draw_weekday, CASE WHEN account_type_id = 1 THEN greatest(forecast_min, 20) ELSE forecast_min END AS forecast_min
    FROM default_draws JOIN accounts USING (account_id)""")
def set_forecast_min(t):
    return thresholds.forecast_floor(t.default_draws, t.accounts, [1], 20).select(
        "account_id", "publication_id", "draw_weekday", "forecast_min")


@query("transfer_total_duration", "transfers", """
    WITH u AS (SELECT device_id, mfst_code, CAST(ul_start AS DATE) AS day, min(ul_start) AS up FROM transfers WHERE ul_start IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT device_id, mfst_code, mfst_date AS day, max(dl_end) AS down FROM transfers WHERE dl_end IS NOT NULL GROUP BY 1, 2, 3)
    SELECT device_id, mfst_code, CAST(day AS VARCHAR) AS day, CAST(up AS VARCHAR) AS upload_started, CAST(down AS VARCHAR) AS download_finished,
           date_diff('second', date_trunc('second', up), date_trunc('second', down)) AS total_seconds FROM u JOIN d USING (device_id, mfst_code, day)""")
def transfer_total_duration(t):
    return logs.transfer_total(t.transfers)


@query("late_manifest_uploads", "transfers", """
    SELECT transfer_id, mfst_code, CAST(mfst_date AS VARCHAR) AS mfst_date, CAST(ul_start AS VARCHAR) AS ul_start FROM transfers
    WHERE CAST(ul_start AS DATE) - mfst_date = 1""")
def late_manifest_uploads(t):
    return logs.late_uploads(t.transfers).select("transfer_id", "mfst_code", "mfst_date", "ul_start")


@query("repeated_requests", "weblog", """
    SELECT page, query, count(*) AS occurrences, CAST(min(logged_at) AS VARCHAR) AS first_at, CAST(max(logged_at) AS VARCHAR) AS last_at
    FROM weblog GROUP BY page, query HAVING count(*) > 1""")
def repeated_requests(t):
    return logs.repeated_requests(t.weblog)


@query("export_parameters", "manifests", f"""
    SELECT manifest_id, CASE manifest_type_id WHEN 1 THEN 'Delivery' WHEN 2 THEN 'Collection' ELSE 'Returns' END AS export_type,
           CAST(manifest_date AS VARCHAR) AS begin_date, CAST(manifest_date + 6 AS VARCHAR) AS end_date,
           manifest_date - DATE '{AS_OF}' AS begin_offset, manifest_date + 6 - DATE '{AS_OF}' AS end_offset FROM manifests""")
def export_parameters(t):
    kind = F.when(F.col("manifest_type_id") == 1, "Delivery").when(F.col("manifest_type_id") == 2, "Collection").otherwise("Returns")
    text = F.concat(kind, F.lit(' "StartDate='), F.date_format("manifest_date", "MM/dd/yyyy"), F.lit(";EndDate="),
                    F.date_format(F.date_add("manifest_date", 6), "MM/dd/yyyy"), F.lit('"'))
    return logs.export_parameters(t.manifests.select("manifest_id", text.alias("setting")), AS_OF).drop("setting")


@query("rollups_without_children", "rollups accounts", """
    SELECT rollup_id, rollup_code FROM rollups r WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.rollup_id = r.rollup_id AND a.imported = 1)""")
def rollups_without_children(t):
    """Rollups that no imported account belongs to."""
    return joins.anti(t.rollups, t.accounts.where("imported = 1 and rollup_id is not null"), ["rollup_id"]).select("rollup_id", "rollup_code")


@query("write_off_with_audit", "daily audits", f"""
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(top, 0) + 1 AS audit_id, 6 AS audit_user_id,
           'AdjAdminAmount' AS audit_field, CAST(coalesce(adj_admin_amount, 0) - ({NET}) AS VARCHAR) AS audit_value
    FROM daily LEFT JOIN (SELECT account_id, publication, draw_date, max(audit_id) AS top FROM audits GROUP BY 1, 2, 3) USING (account_id, publication, draw_date)""")
def write_off_with_audit(t):
    """Audit entries of the adjustment that brings every net to zero."""
    return audits.write_off(t.daily, t.audits, DAILY_KEY, 6)[1]


@query("write_off_result", "daily", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, 0 AS net FROM daily""")
def write_off_result(t):
    """After the write-off every net is zero."""
    return sales.with_net(audits.write_off(t.daily, t.audits, DAILY_KEY, 6)[0]).select(*DAILY_KEY, "net")


@query("returns_from_audit", "daily audits", """
    SELECT d.account_id, d.publication, CAST(d.draw_date AS VARCHAR) AS draw_date, coalesce(CAST(v AS BIGINT), ret_amount) AS ret_amount
    FROM daily d LEFT JOIN (SELECT account_id, publication, draw_date, arg_max(audit_value, audit_id) AS v FROM audits GROUP BY 1, 2, 3)
    USING (account_id, publication, draw_date)""")
def returns_from_audit(t):
    return audits.returns_from_audit(t.daily, t.audits, DAILY_KEY).select(*DAILY_KEY, "ret_amount")


@query("rates_from_defaults", "draws default_draws", """
    SELECT d.account_id, d.publication_id, CAST(d.draw_date AS VARCHAR) AS draw_date, CAST(d.draw_rate AS DOUBLE) AS old_rate,
           CAST(x.draw_rate AS DOUBLE) AS new_rate
    FROM draws d JOIN default_draws x USING (account_id, publication_id, draw_weekday) WHERE d.draw_rate <> x.draw_rate""")
def rates_from_defaults(t):
    """Dated rates that the weekday template would change."""
    keys = ["account_id", "publication_id", "draw_weekday"]
    rates = t.default_draws.select(*keys, F.col("draw_rate").alias("new_rate"))
    return t.draws.join(rates, keys).where("draw_rate <> new_rate").select(*DRAW_KEY, F.col("draw_rate").alias("old_rate"), "new_rate")


@query("zero_out_defaults", "default_draws publications", """
    SELECT account_id, publication_id, draw_weekday, CASE WHEN brand_no = 7 AND draw_weekday = 1 THEN 0 ELSE draw_amount END AS draw_amount
    FROM default_draws JOIN publications USING (publication_id)""")
def zero_out_defaults(t):
    """One publication's Sunday template set to zero."""
    rows = t.default_draws.join(t.publications.select("publication_id", "brand_no"), "publication_id")
    hit = (F.col("brand_no") == 7) & (F.col("draw_weekday") == 1)
    return rows.select("account_id", "publication_id", "draw_weekday", F.when(hit, 0).otherwise(F.col("draw_amount")).alias("draw_amount"))


@query("deactivate_stale", "daily", """
    WITH last AS (SELECT account_id, publication, max(CASE WHEN draw_amount > 0 THEN draw_date END) AS last FROM daily GROUP BY 1, 2)
    SELECT account_id, publication, CAST(NOT coalesce(last < DATE '2024-01-31' - 3, false) AS INTEGER) AS active FROM last""")
def deactivate_stale(t):
    """Pairs with their active flag after those without a recent draw are switched off."""
    keys = ["account_id", "publication"]
    gone = sales.stale(t.daily, keys, "2024-01-31", 3).select(*keys, F.lit(0).alias("active"))
    return t.daily.select(*keys).distinct().join(gone, keys, "left").select(*keys, F.coalesce("active", F.lit(1)).alias("active"))


@query("users_by_plan", "subscriptions", """
    SELECT plan_id, count(DISTINCT user_id) AS users, count(*) AS plans, CAST(max(purchase_date) AS VARCHAR) AS last_purchase FROM subscriptions GROUP BY plan_id""")
def users_by_plan(t):
    return t.subscriptions.groupBy("plan_id").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("plans"),
                                                  F.max("purchase_date").alias("last_purchase"))


@query("days_from_now", "manifests", f"""
    SELECT manifest_date - DATE '{AS_OF}' AS days_from_now, count(*) AS manifests FROM manifests GROUP BY 1""")
def days_from_now(t):
    return t.manifests.groupBy(F.datediff("manifest_date", F.lit(AS_OF).cast("date")).alias("days_from_now")).agg(
        F.count(F.lit(1)).alias("manifests"))


@query("forecast_snapshot_diff", "default_draws", """
    SELECT account_id, publication_id, draw_weekday, draw_amount AS left_draw_amount, CASE WHEN draw_weekday <> 7 THEN draw_amount + forecast_min % 2 END AS right_draw_amount,
           CASE WHEN draw_weekday = 7 THEN 'left only' WHEN forecast_min % 2 = 0 THEN 'same' ELSE 'changed' END AS status FROM default_draws""")
def forecast_snapshot_diff(t):
    """The template against a later copy of it."""
    keys = ["account_id", "publication_id", "draw_weekday"]
    later = t.default_draws.where("draw_weekday <> 7").withColumn("draw_amount", F.col("draw_amount") + F.col("forecast_min") % 2)
    return sets.diff_tables(t.default_draws, later, keys, ["draw_amount"])
