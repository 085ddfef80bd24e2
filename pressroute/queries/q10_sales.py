"""Sales reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.values import net_sales as net_column
from pressroute.plans import sales
from pressroute.queries.q02_filters import NET
from pressroute.queries.registry import query
from pressroute.sources.frames import DAILY_KEY, DRAW_KEY

PAIR = ["account_id", "publication"]


@query("net_sales", "draws", f"""
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, {NET} AS net FROM draws""")
def net_sales(t):
    return t.draws.select(*DRAW_KEY, net_column().alias("net"))


def _history_sql(weeks: int) -> str:
    cols = ", ".join(f"CAST(d{k}.draw_date AS VARCHAR) AS date_{k}, d{k}.net AS net_{k}" for k in range(1, weeks + 1))
    text = ", ".join(f"d{k}.net" for k in range(1, weeks + 1))
    sql = f"""WITH n AS (SELECT account_id, publication, draw_date, draw_amount, {NET} AS net FROM daily),
    lc AS (SELECT account_id, publication, draw_date, CAST(changed_at AS VARCHAR) AS changed_at, old_draw, new_draw, change_type_id FROM (
        SELECT *, rank() OVER (PARTITION BY account_id, publication, draw_date ORDER BY changed_at DESC) AS r FROM history) WHERE r = 1)
    SELECT d0.account_id, d0.publication, CAST(d0.draw_date AS VARCHAR) AS draw_date, d0.draw_amount, {cols},
           concat_ws(', ', {text}) AS net_text, lc.changed_at, lc.old_draw, lc.new_draw, lc.change_type_id
    FROM n d0"""
    for k in range(1, weeks + 1):
        sql += (f" LEFT JOIN n d{k} ON d{k}.account_id = d{k-1}.account_id AND d{k}.publication = d{k-1}.publication"
                f" AND d{k}.draw_date = d{k-1}.draw_date - 7")
    return sql + " JOIN lc ON lc.account_id = d0.account_id AND lc.publication = d0.publication AND lc.draw_date = d0.draw_date"


@query("sales_history", "daily history", _history_sql(7))
def sales_history(t):
    """Seven weeks of net per draw, for all dates, with the last change of the draw."""
    wide = sales.sales_history(t.daily, PAIR)
    out = sales.history_with_last_change(wide, t.history, DAILY_KEY)
    weeks = [c for k in range(1, 8) for c in (f"date_{k}", f"net_{k}")]
    return out.select(*DAILY_KEY, "draw_amount", *weeks, "net_text", "changed_at", "old_draw", "new_draw", "change_type_id")


@query("weekly_net_by_zip", "draw_lines accounts publications", f"""
    WITH n AS (SELECT postal_code, pub_short_name, draw_date - (draw_weekday - 1) AS week_start, draw_weekday - 1 AS i, {NET} AS net
        FROM draw_lines JOIN accounts USING (account_id) JOIN publications USING (publication_id))
    SELECT postal_code, pub_short_name, CAST(week_start AS VARCHAR) AS week_start,
           {", ".join(f"CAST(sum(CASE WHEN i = {i} THEN net END) AS BIGINT) AS net{i}" for i in range(7))}
    FROM n GROUP BY postal_code, pub_short_name, week_start""")
def weekly_net_by_zip(t):
    """Every week on file, starting on Sunday."""
    week_start = F.date_sub("draw_date", F.dayofweek("draw_date") - 1)
    return sales.weekly_net(t.draw_lines, t.accounts, t.publications, week_start)


@query("week_over_week", "daily", """
    SELECT d.account_id, d.publication, CAST(d.draw_date AS VARCHAR) AS draw_date, d.draw_amount, a.draw_amount AS draw_amount_1,
           b.draw_amount AS draw_amount_2, d.draw_amount - a.draw_amount AS change FROM daily d
    LEFT JOIN daily a ON a.account_id = d.account_id AND a.publication = d.publication AND a.draw_date = d.draw_date - 7
    LEFT JOIN daily b ON b.account_id = a.account_id AND b.publication = a.publication AND b.draw_date = a.draw_date - 7""")
def week_over_week(t):
    return sales.week_over_week(t.daily, PAIR)


@query("week_over_week_rollup", "daily children rollups", """
    WITH r AS (SELECT rollup_code, publication, draw_date, CAST(sum(draw_amount) AS BIGINT) AS draw_amount
        FROM daily JOIN children ON child_account_id = account_id JOIN rollups USING (rollup_id) GROUP BY 1, 2, 3)
    SELECT d.rollup_code, d.publication, CAST(d.draw_date AS VARCHAR) AS draw_date, d.draw_amount, a.draw_amount AS draw_amount_1,
           b.draw_amount AS draw_amount_2, d.draw_amount - a.draw_amount AS change FROM r d
    LEFT JOIN r a ON a.rollup_code = d.rollup_code AND a.publication = d.publication AND a.draw_date = d.draw_date - 7
    LEFT JOIN r b ON b.rollup_code = a.rollup_code AND b.publication = a.publication AND b.draw_date = a.draw_date - 7""")
def week_over_week_rollup(t):
    """The same comparison summed per rollup account."""
    rows = (t.daily.join(t.children.withColumnRenamed("child_account_id", "account_id"), "account_id")
            .join(t.rollups, "rollup_id").groupBy("rollup_code", "publication", "draw_date", "draw_weekday")
            .agg(F.sum("draw_amount").alias("draw_amount")))
    return sales.week_over_week(rows, ["rollup_code", "publication"])


@query("pct_change", "daily", """
    SELECT a.account_id, a.publication, CAST(a.draw_date AS VARCHAR) AS draw_date, b.draw_amount AS old_draw, a.draw_amount AS new_draw,
           round(CAST(b.draw_amount AS DOUBLE) / a.draw_amount * 100, 4) AS pct
    FROM daily a JOIN daily b ON b.account_id = a.account_id AND b.publication = a.publication AND b.draw_date = a.draw_date - 7
    WHERE a.draw_amount > b.draw_amount""")
def pct_change(t):
    return sales.pct_change(t.daily, PAIR).withColumn("pct", F.round(F.col("old_draw").cast("double") / F.col("new_draw") * 100, 4))


@query("pct_change_average", "daily", """
    SELECT a.publication, count(*) AS risen, round(avg(round(CAST(b.draw_amount AS DOUBLE) / a.draw_amount * 100, 6)), 3) AS avg_pct
    FROM daily a JOIN daily b ON b.account_id = a.account_id AND b.publication = a.publication AND b.draw_date = a.draw_date - 7
    WHERE a.draw_amount > b.draw_amount GROUP BY a.publication""")
def pct_change_average(t):
    return sales.pct_change(t.daily, PAIR).groupBy("publication").agg(
        F.count(F.lit(1)).alias("risen"), F.round(F.avg(F.col("pct").cast("double")), 3).alias("avg_pct"))


@query("import_verify", "draw_lines load publications", """
    SELECT CAST(d.draw_date AS VARCHAR) AS draw_date, d.pub_short_name, d.table_draw, f.file_draw FROM (
        SELECT draw_date, pub_short_name, CAST(sum(draw_amount) AS BIGINT) AS table_draw FROM draw_lines JOIN publications USING (publication_id) GROUP BY 1, 2) d
    LEFT JOIN (SELECT draw_date, pub_short_name, CAST(sum(draw_amount) AS BIGINT) AS file_draw FROM load JOIN publications USING (publication_id) GROUP BY 1, 2) f
    USING (draw_date, pub_short_name)""")
def import_verify(t):
    """Loaded totals beside the totals of the file, by date and publication."""
    def totals(df, name):
        return (df.select("draw_date", "publication_id", "draw_amount")
                .join(t.publications.select("publication_id", "pub_short_name"), "publication_id")
                .groupBy("draw_date", "pub_short_name").agg(F.sum("draw_amount").alias(name)))
    return totals(t.draw_lines, "table_draw").join(totals(t.load, "file_draw"), ["draw_date", "pub_short_name"], "left")


@query("densify_facts", "daily", """
    SELECT k.account_id, k.publication, CAST(day AS VARCHAR) AS draw_date, CAST(extract(dow FROM day) + 1 AS INTEGER) AS draw_weekday, 0 AS draw_amount
    FROM (SELECT DISTINCT account_id, publication FROM daily) k,
         (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)
    LEFT JOIN daily d ON d.account_id = k.account_id AND d.publication = k.publication AND d.draw_date = day WHERE d.draw_date IS NULL""")
def densify_facts(t):
    return sales.densify(t.daily, PAIR, "2024-01-01", "2024-01-30")


@query("pull_forward", "daily", """
    SELECT s.account_id, s.publication, CAST(s.draw_date + 7 AS VARCHAR) AS draw_date, s.draw_amount AS source_draw,
           CASE WHEN x.draw_date IS NULL THEN 'insert' ELSE 'update' END AS action, x.draw_amount AS old_draw
    FROM daily s LEFT JOIN daily x ON x.account_id = s.account_id AND x.publication = s.publication AND x.draw_date = s.draw_date + 7""")
def pull_forward(t):
    return sales.pull_forward(t.daily, PAIR)


ZERO_SQL = ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE draw_date > CAST(DATE '2002-01-01' - INTERVAL {m} MONTH AS DATE)) > 0"
    f" AND sum(amount) FILTER (WHERE draw_date > CAST(DATE '2002-01-01' - INTERVAL {m} MONTH AS DATE)) = 0 THEN {m} END" for m in range(1, 13))


@query("zero_months", "draw_lines", f"""
    SELECT account_id, publication_id, greatest({ZERO_SQL}) AS months_with_zero
    FROM (SELECT account_id, publication_id, draw_date, coalesce(ret_amount, 0) AS amount FROM draw_lines)
    GROUP BY account_id, publication_id HAVING greatest({ZERO_SQL}) IS NOT NULL""")
def zero_months(t):
    """Accounts and publications without returns for 1 to 12 trailing months (draws themselves are never zero here)."""
    rows = t.draw_lines.withColumn("draw_amount", F.coalesce("ret_amount", F.lit(0)))
    return sales.zero_draw_months(rows, ["account_id", "publication_id"], "2002-01-01")


@query("stale_keys", "daily", """
    SELECT account_id, publication, CAST(max(draw_date) AS VARCHAR) AS last_nonzero FROM daily WHERE draw_amount > 0
    GROUP BY account_id, publication HAVING max(draw_date) < DATE '2024-01-31' - 3""")
def stale_keys(t):
    return sales.stale(t.daily, PAIR, "2024-01-31", 3)


@query("export_delta", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(adj_amount, 0) + coalesce(adj_admin_amount, 0) AS adj_total,
           CAST(coalesce(ret_amount, 0) <> coalesce(ret_export_last, 0) AS INTEGER) AS returns_due,
           CAST(coalesce(adj_amount, 0) + coalesce(adj_admin_amount, 0) <> coalesce(adj_export_last, 0) AS INTEGER) AS adjustments_due
    FROM draws WHERE coalesce(ret_amount, 0) <> coalesce(ret_export_last, 0)
       OR coalesce(adj_amount, 0) + coalesce(adj_admin_amount, 0) <> coalesce(adj_export_last, 0)""")
def export_delta(t):
    return sales.export_delta(t.draws).select(*DRAW_KEY, "adj_total", "returns_due", "adjustments_due")


@query("export_rollback", "draws load", """
    SELECT d.account_id, d.publication_id, CAST(d.draw_date AS VARCHAR) AS draw_date, d.ret_amount,
           CASE WHEN l.account_id IS NOT NULL THEN d.ret_amount ELSE d.ret_export_last END AS ret_export_last
    FROM draws d LEFT JOIN load l ON l.account_id = d.account_id AND l.publication_id = d.publication_id AND l.draw_date = d.draw_date""")
def export_rollback(t):
    """The load file stands in for the archived export file."""
    return sales.export_rollback(t.draws, t.load, DRAW_KEY).select(*DRAW_KEY, "ret_amount", "ret_export_last")


@query("bulk_rollup_compare", "history accounts rollups", """
    WITH c AS (SELECT history_id, acct_code, rollup_code, publication, draw_date, old_draw, new_draw FROM history
        JOIN accounts USING (account_id) JOIN rollups USING (rollup_id) WHERE old_draw <> new_draw)
    SELECT history_id, acct_code, rollup_code, publication, CAST(draw_date AS VARCHAR) AS draw_date, old_draw, new_draw,
           CAST(sum(old_draw) OVER w AS BIGINT) AS rollup_old, CAST(sum(new_draw) OVER w AS BIGINT) AS rollup_new
    FROM c WINDOW w AS (PARTITION BY rollup_code, publication, draw_date)""")
def bulk_rollup_compare(t):
    return sales.rollup_totals(t.history, t.accounts, t.rollups).select(
        "history_id", "acct_code", "rollup_code", "publication", "draw_date", "old_draw", "new_draw", "rollup_old", "rollup_new")
