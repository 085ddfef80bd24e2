"""Sorts, top rows, set operations and spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.dates import date_spine
from pressroute.operators import joins, sets, sorting
from pressroute.queries.registry import query


@query("order_by", "draw_lines", """
    SELECT account_id, CAST(draw_date AS VARCHAR) AS draw_date, CAST(sum(draw_amount) AS BIGINT) AS draw_amount
    FROM draw_lines GROUP BY account_id, draw_date ORDER BY draw_amount DESC, account_id, draw_date""")
def order_by(t):
    return t.draw_lines.groupBy("account_id", "draw_date").agg(F.sum("draw_amount").alias("draw_amount")).orderBy(
        F.desc("draw_amount"), "account_id", "draw_date")


@query("order_choice", "accounts", "SELECT account_id, acct_code, postal_code FROM accounts ORDER BY postal_code, acct_code")
def order_choice(t):
    return sorting.order_by_choice(t.accounts.select("account_id", "acct_code", "postal_code"),
                                   {1: ["acct_code"], 2: ["postal_code", "acct_code"]}, 2, ["account_id"])


@query("top_n", "draw_lines", """
    SELECT account_id, publication_id, CAST(sum(draw_amount) AS BIGINT) AS draw_amount FROM draw_lines
    GROUP BY account_id, publication_id ORDER BY draw_amount DESC, account_id, publication_id LIMIT 25""")
def top_n(t):
    sums = t.draw_lines.groupBy("account_id", "publication_id").agg(F.sum("draw_amount").alias("draw_amount"))
    return sorting.top_n(sums, [F.desc("draw_amount"), "account_id", "publication_id"], 25)


@query("top_unordered", "draw_lines", """
    SELECT CAST(least(count(*), 1) AS BIGINT) AS picked, CAST(least(count(*), 1) AS BIGINT) AS qualifying FROM draw_lines WHERE ret_amount > 0""")
def top_unordered(t):
    """Any one row that qualifies: the choice is open, so the report counts the picked row and finds it among those on file."""
    keys = ["order_key", "line_no"]
    one = t.draw_lines.where("ret_amount > 0").select(*keys).limit(1)
    found = one.join(t.draw_lines.where("ret_amount > 0").select(*keys, F.lit(1).alias("there")).distinct(), keys, "left")
    return found.agg(F.count(F.lit(1)).alias("picked"), F.count("there").alias("qualifying"))


@query("min_or_max_row", "manifests", """
    SELECT manifest_id, CAST(manifest_date AS VARCHAR) AS manifest_date FROM manifests
    WHERE manifest_date = (SELECT max(manifest_date) FROM manifests)""")
def min_or_max_row(t):
    return sorting.extreme_rows(t.manifests, "manifest_date").select("manifest_id", "manifest_date")


@query("union_all", "draw_lines manifests system_log", """
    SELECT day, source, count(*) AS n FROM (
        SELECT CAST(draw_date AS VARCHAR) AS day, 'draw' AS source FROM draw_lines
        UNION ALL SELECT CAST(manifest_date AS VARCHAR), 'manifest' FROM manifests
        UNION ALL SELECT CAST(CAST(logged_at AS DATE) AS VARCHAR), 'log' FROM system_log) GROUP BY day, source""")
def union_all(t):
    def part(df, date, source):
        return df.groupBy(F.to_date(date).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(source))
    return sets.stack([part(t.draw_lines, "draw_date", "draw"), part(t.manifests, "manifest_date", "manifest"),
                       part(t.system_log, "logged_at", "log")])


@query("union_distinct", "draw_lines assignments publications", """
    SELECT account_id, brand_no FROM draw_lines JOIN publications USING (publication_id)
    UNION SELECT account_id, brand_no FROM assignments""")
def union_distinct(t):
    return t.account_brands.select("account_id", "brand_no").unionByName(t.assignments.select("account_id", "brand_no")).distinct()


@query("set_difference", "assignments", """
    SELECT DISTINCT template_id, account_id, brand_no FROM assignments a WHERE frequency & 2 > 0
      AND NOT EXISTS (SELECT 1 FROM assignments b WHERE b.template_id = a.template_id AND b.account_id = a.account_id
                      AND b.brand_no = a.brand_no AND b.frequency & 4 > 0)""")
def set_difference(t):
    """On Monday's manifest but not on Tuesday's."""
    keys = ["template_id", "account_id", "brand_no"]
    days = joins.on_weekday(t.assignments, "frequency", "weekday")
    return sets.minus(days.where("weekday = 2").select(*keys).distinct(), days.where("weekday = 3"), keys)


@query("set_intersection", "draw_lines manifests", """
    SELECT CAST(draw_date AS VARCHAR) AS day FROM draw_lines INTERSECT SELECT CAST(manifest_date AS VARCHAR) FROM manifests""")
def set_intersection(t):
    return sets.intersect_keys(t.draw_lines.select(F.col("draw_date").alias("day")),
                               t.manifests.select(F.col("manifest_date").alias("day")), ["day"])


@query("diff_tables", "load load_base", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, b.draw_amount AS left_draw_amount,
           l.draw_amount AS right_draw_amount, CAST(b.draw_rate AS DOUBLE) AS left_draw_rate, CAST(l.draw_rate AS DOUBLE) AS right_draw_rate,
           CASE WHEN l.draw_amount IS NULL THEN 'left only' WHEN b.draw_amount IS NULL THEN 'right only'
                WHEN b.draw_amount = l.draw_amount AND b.draw_rate = l.draw_rate THEN 'same' ELSE 'changed' END AS status
    FROM load_base b FULL JOIN load l USING (account_id, publication_id, draw_date)""")
def diff_tables(t):
    return sets.diff_tables(t.load_base, t.load, ["account_id", "publication_id", "draw_date"], ["draw_amount", "draw_rate"])


@query("differing_rows", "load load_base", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, b.draw_amount AS left_draw_amount,
           l.draw_amount AS right_draw_amount, CAST(b.draw_rate AS DOUBLE) AS left_draw_rate, CAST(l.draw_rate AS DOUBLE) AS right_draw_rate,
           CASE WHEN l.draw_amount IS NULL THEN 'left only' WHEN b.draw_amount IS NULL THEN 'right only' ELSE 'changed' END AS status
    FROM load_base b FULL JOIN load l USING (account_id, publication_id, draw_date)
    WHERE b.draw_amount IS DISTINCT FROM l.draw_amount OR b.draw_rate IS DISTINCT FROM l.draw_rate""")
def differing_rows(t):
    """Only the rows that differ, from the months and buckets whose checksums do."""
    month = F.date_format("draw_date", "yyyy-MM")
    return sets.differing_rows(t.load_base.withColumn("month", month), t.load.withColumn("month", month),
                               ["account_id", "publication_id", "draw_date"], ["draw_amount", "draw_rate"], "month")


@query("recursive_dates", "draw_lines", """
    SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n
    FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
    LEFT JOIN (SELECT draw_date AS day, count(*) AS n FROM draw_lines GROUP BY draw_date) USING (day)""")
def recursive_dates(t):
    """Every date of a range with its number of draws, days without any included."""
    counts = t.draw_lines.groupBy(F.col("draw_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return date_spine(t.spark, "1995-01-01", "2001-12-31", "1 day", "day").join(counts, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("recursive_weekdays", "assignments", """
    SELECT CAST(d AS INTEGER) AS weekday, template_id, count(*) AS items
    FROM assignments, range(1, 8) AS r(d) WHERE frequency & (1 << (d - 1)) > 0 GROUP BY d, template_id""")
def recursive_weekdays(t):
    return joins.on_weekday(t.assignments, "frequency", "weekday").groupBy("weekday", "template_id").agg(
        F.count(F.lit(1)).alias("items"))


@query("number_table", "accounts", """
    SELECT account_id, CAST(n AS INTEGER) AS n, CAST(account_id * n AS BIGINT) AS product
    FROM accounts, range(1, 8) AS r(n)""")
def number_table(t):
    """Numbers 1 to 7 beside every account, expanded per row."""
    return t.accounts.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7)))).select(
        "account_id", "n", (F.col("account_id") * F.col("n")).alias("product"))
