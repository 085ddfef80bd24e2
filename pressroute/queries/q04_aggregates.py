"""Aggregates, pivots and text lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.bits import DAY_CODES
from pressroute.operators import aggregates as agg
from pressroute.plans import imports, schedules
from pressroute.queries.registry import query
from pressroute.sources.frames import DAILY_KEY

TEMPLATE = "'MT' || lpad(CAST(template_id AS VARCHAR), CAST(greatest(3, length(CAST(template_id AS VARCHAR))) AS INTEGER), '0')"


def week_sql(fn: str, column: str, prefix: str, day: str = "draw_weekday") -> str:
    return ", ".join(f"CAST({fn}(CASE WHEN {day} = {i + 1} THEN {column} END) AS BIGINT) AS {prefix}{d.lower()}"
                     for i, d in enumerate(DAY_CODES))


@query("group_agg", "draw_lines", """
    SELECT CAST(draw_date AS VARCHAR) AS draw_date, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS total,
           min(draw_amount) AS low, max(draw_amount) AS high FROM draw_lines GROUP BY draw_date""")
def group_agg(t):
    d = F.col("draw_amount")
    return t.draw_lines.groupBy("draw_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("total"), F.min(d).alias("low"), F.max(d).alias("high"))


@query("agg_avg", "draws", """
    SELECT account_id, round(avg(CAST(forecast AS DOUBLE)), 4) AS avg_ratio
    FROM (SELECT account_id, round(CAST(coalesce(ret_amount, 0) AS DOUBLE) / draw_amount * 100, 6) AS forecast FROM draws) GROUP BY account_id""")
def agg_avg(t):
    share = F.round(F.coalesce("ret_amount", F.lit(0)).cast("double") / F.col("draw_amount") * 100, 6)
    return t.draws.groupBy("account_id").agg(F.round(F.avg(share), 4).alias("avg_ratio"))


@query("agg_count_distinct", "draw_lines", """
    SELECT account_id, count(DISTINCT publication_id) AS publications, count(DISTINCT draw_date) AS days FROM draw_lines GROUP BY account_id""")
def agg_count_distinct(t):
    return t.draw_lines.groupBy("account_id").agg(
        F.count_distinct("publication_id").alias("publications"), F.count_distinct("draw_date").alias("days"))


@query("agg_two_level", "audits", """
    SELECT publication, max(users) AS most_users, CAST(sum(entries) AS BIGINT) AS entries FROM (
        SELECT account_id, publication, draw_date, count(DISTINCT audit_user_id) AS users, count(*) AS entries
        FROM audits GROUP BY 1, 2, 3) GROUP BY publication""")
def agg_two_level(t):
    per_draw = t.audit_events.groupBy(*DAILY_KEY).agg(
        F.count_distinct("audit_user_id").alias("users"), F.count(F.lit(1)).alias("entries"))
    return per_draw.groupBy("publication").agg(F.max("users").alias("most_users"), F.sum("entries").alias("entries"))


@query("conditional_sum", "draw_lines", """
    SELECT publication_id, CAST(sum(CASE WHEN ret_amount > 0 THEN ret_amount ELSE 0 END) AS BIGINT) AS returned,
           CAST(sum(CASE WHEN adj_amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS cuts FROM draw_lines GROUP BY publication_id""")
def conditional_sum(t):
    return t.draw_lines.groupBy("publication_id").agg(
        agg.sum_if(F.col("ret_amount") > 0, F.col("ret_amount")).alias("returned"),
        agg.sum_if(F.col("adj_amount") < 0, F.lit(1)).alias("cuts"))


@query("having", "draw_lines", """
    SELECT account_id, publication_id, CAST(sum(coalesce(ret_amount, 0)) AS BIGINT) AS returned FROM draw_lines
    GROUP BY account_id, publication_id HAVING sum(coalesce(ret_amount, 0)) = 0 AND count(*) > 1""")
def having(t):
    return t.draw_lines.groupBy("account_id", "publication_id").agg(
        F.sum(F.coalesce("ret_amount", F.lit(0))).alias("returned"), F.count(F.lit(1)).alias("n")).where(
        "returned = 0 and n > 1").drop("n")


@query("distinct_rows", "draw_lines", "SELECT DISTINCT account_id, CAST(draw_date AS VARCHAR) AS draw_date FROM draw_lines")
def distinct_rows(t):
    return t.draw_lines.select("account_id", "draw_date").distinct()


@query("group_by_expression", "system_log", """
    SELECT CAST(extract(hour FROM logged_at) AS INTEGER) AS hour, coalesce(nullif(split_part(message, ' ', 1), 'error'), 'failed') AS kind,
           count(*) AS n FROM system_log GROUP BY 1, 2""")
def group_by_expression(t):
    kind = F.coalesce(F.nullif(F.split_part("message", F.lit(" "), F.lit(1)), F.lit("error")), F.lit("failed"))
    return t.system_log.groupBy(F.hour("logged_at").alias("hour"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("bit_union_sum", "assignments", """
    WITH masks AS (SELECT DISTINCT template_id, frequency FROM assignments),
    u AS (SELECT template_id, CAST(sum(frequency) AS BIGINT) AS frequency_sum, bit_or(frequency) AS frequency_union
          FROM masks GROUP BY template_id)
    SELECT *, (SELECT string_agg(name, ', ' ORDER BY i) FROM (VALUES (0, 'SUN'), (1, 'MON'), (2, 'TUE'), (3, 'WED'),
        (4, 'THU'), (5, 'FRI'), (6, 'SAT')) AS d(i, name) WHERE u.frequency_union & (1 << i) > 0) AS day_list FROM u""")
def bit_union_sum(t):
    return schedules.frequency_report(t.assignments)


@query("csv_agg", "draw_lines publications", """
    SELECT account_id, string_agg(DISTINCT pub_short_name, ', ' ORDER BY pub_short_name) AS csv
    FROM draw_lines JOIN publications USING (publication_id) GROUP BY account_id""")
def csv_agg(t):
    return agg.csv_agg(t.account_brands, ["account_id"], "pub_short_name")


@query("nested_csv_agg", "load publications", """
    SELECT string_agg(pub_short_name || ' (' || years || ')', ', ' ORDER BY pub_short_name || ' (' || years || ')') AS csv, account_id
    FROM (SELECT account_id, pub_short_name, string_agg(DISTINCT y, ', ' ORDER BY y) AS years
          FROM (SELECT account_id, pub_short_name, CAST(extract(year FROM draw_date) AS VARCHAR) AS y
                FROM load JOIN publications USING (publication_id)) GROUP BY 1, 2) GROUP BY account_id""")
def nested_csv_agg(t):
    rows = t.load.join(t.publications.select("publication_id", "pub_short_name"), "publication_id").select(
        "account_id", "pub_short_name", F.year("draw_date").cast("string").alias("year"))
    return agg.nested_csv_agg(rows, ["account_id"], "pub_short_name", "year")


@query("running_concat", "assignments", f"""
    SELECT account_id, string_agg(DISTINCT {TEMPLATE}, ';' ORDER BY {TEMPLATE}) AS manifests FROM assignments GROUP BY account_id""")
def running_concat(t):
    return agg.csv_agg(t.assignments.withColumn("code", schedules.template_code()), ["account_id"], "code", ";", "manifests")


@query("pivot_static", "audits", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date,
           max(CASE WHEN audit_id = 1 THEN CAST(audit_value AS INTEGER) END) AS "1",
           max(CASE WHEN audit_id = 2 THEN CAST(audit_value AS INTEGER) END) AS "2",
           max(CASE WHEN audit_id = 3 THEN CAST(audit_value AS INTEGER) END) AS "3",
           max(CASE WHEN audit_id = 4 THEN CAST(audit_value AS INTEGER) END) AS "4",
           max(CASE WHEN audit_id = 5 THEN CAST(audit_value AS INTEGER) END) AS "5",
           string_agg(CASE WHEN audit_id > 5 THEN audit_id || '=' || audit_value END, ', ' ORDER BY audit_id) AS rest
    FROM audits GROUP BY 1, 2, 3""")
def pivot_static(t):
    """Five columns as the report prints them; what has no column is listed beside them."""
    rows = t.audits.withColumn("amount", F.col("audit_value").cast("int"))
    return agg.pivot_rest(rows, DAILY_KEY, "audit_id", [1, 2, 3, 4, 5], {"amount": ""})


@query("pivot_long", "audits", """
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, audit_id, CAST(sum(CAST(audit_value AS BIGINT)) AS BIGINT) AS amount
    FROM audits GROUP BY 1, 2, 3, 4""")
def pivot_long(t):
    """The form without columns, for any number of values."""
    return agg.pivot_long(t.audits, DAILY_KEY, "audit_id", [F.sum(F.col("audit_value").cast("bigint")).alias("amount")])


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("pivot_dynamic", "draw_lines publications", f"""
    SELECT account_id, {", ".join(f"CAST(sum(CASE WHEN pub_type = '{x}' THEN draw_amount END) AS BIGINT) AS {x}" for x in TYPES)}
    FROM draw_lines JOIN publications USING (publication_id) GROUP BY account_id""")
def pivot_dynamic(t):
    """Columns found at run time from the small publication table, then aggregated per publication before the join."""
    sums = t.draw_lines.groupBy("account_id", "publication_id").agg(F.sum("draw_amount").alias("draw_amount"))
    types = agg.distinct_values(t.publications, "pub_type")
    rows = sums.join(t.publications.select("publication_id", "pub_type"), "publication_id")
    return agg.pivot(rows, ["account_id"], "pub_type", types, [F.sum("draw_amount")])


@query("pivot_case_weekday", "default_draws", f"""
    SELECT account_id, publication_id, {week_sql("max", "draw_amount", "draw_")},
           {week_sql("max", "CAST(draw_rate * 100 AS INTEGER)", "rate_")}
    FROM default_draws GROUP BY account_id, publication_id""")
def pivot_case_weekday(t):
    rows = t.default_draws.withColumn("rate", (F.col("draw_rate") * 100).cast("bigint")).withColumn(
        "draw_amount", F.col("draw_amount").cast("bigint"))
    return agg.flatten_week(rows, ["account_id", "publication_id"], "draw_weekday", {"draw_amount": "draw_", "rate": "rate_"})


@query("pivot_multi_measure", "audits", f"""
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date,
           {", ".join(f"""max(CASE WHEN audit_id = {v} THEN audit_user_id END) AS "{v}_user", max(CASE WHEN audit_id = {v} THEN audit_value END) AS "{v}_value",
           CAST(max(CASE WHEN audit_id = {v} THEN audit_time END) AS VARCHAR) AS "{v}_time" """ for v in range(1, 6))},
           string_agg(CASE WHEN audit_id > 5 THEN audit_id || '=' || audit_user_id || '/' || audit_value || '/' || CAST(audit_time AS VARCHAR) END,
                      ', ' ORDER BY audit_id) AS rest
    FROM audits GROUP BY 1, 2, 3""")
def pivot_multi_measure(t):
    return agg.pivot_rest(t.audits, DAILY_KEY, "audit_id", [1, 2, 3, 4, 5],
                          {"audit_user_id": "_user", "audit_value": "_value", "audit_time": "_time"})


@query("unpivot_weekday", "default_draws", """
    SELECT account_id, publication_id, draw_weekday AS weekday, draw_amount AS amount FROM default_draws""")
def unpivot_weekday(t):
    """The week laid out in columns, then back to rows."""
    keys = ["account_id", "publication_id"]
    wide = agg.flatten_week(t.default_draws, keys, "draw_weekday", {"draw_amount": ""})
    return imports.wide_to_long(wide, keys).withColumnRenamed("draw_amount", "amount")


@query("max_length_profile", "", """
    SELECT 'p_name' AS column_name, max(length(p_name)) AS max_length, 10 AS allowed, max(length(p_name)) > 10 AS too_long FROM part
    UNION ALL SELECT 'p_brand', max(length(p_brand)), 5, max(length(p_brand)) > 5 FROM part
    UNION ALL SELECT 'p_partkey', max(length(CAST(p_partkey AS VARCHAR))), 20, max(length(CAST(p_partkey AS VARCHAR))) > 20 FROM part""")
def max_length_profile(t):
    return agg.length_profile(t.table("part"), {"p_name": 10, "p_brand": 5, "p_partkey": 20})


@query("ratio_of_counts", "transfers", """
    SELECT mfst_code, round(CAST(count(*) FILTER (WHERE ul_end IS NULL) AS DOUBLE) / count(*) * 100, 4) AS percent_open
    FROM transfers GROUP BY mfst_code""")
def ratio_of_counts(t):
    return t.transfers.groupBy("mfst_code").agg(
        F.round(agg.percent_of(F.col("ul_end").isNull()).cast("double"), 4).alias("percent_open"))


@query("min_max_range", "draw_lines manifests", """
    SELECT 'draws' AS tab, CAST(min(draw_date) AS VARCHAR) AS first_date, CAST(max(draw_date) AS VARCHAR) AS last_date FROM draw_lines
    UNION ALL SELECT 'manifests', CAST(min(manifest_date) AS VARCHAR), CAST(max(manifest_date) AS VARCHAR) FROM manifests""")
def min_max_range(t):
    def dates(df, name, column):
        return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date")).select(
            F.lit(name).alias("tab"), "first_date", "last_date")
    return dates(t.draw_lines, "draws", "draw_date").unionByName(dates(t.manifests, "manifests", "manifest_date"))
