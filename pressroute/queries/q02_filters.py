"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.bits import freq_matches, not_single_day
from pressroute.functions.values import case_map, net_sales, null_safe_ne
from pressroute.operators import filters
from pressroute.operators.joins import split_join
from pressroute.queries.registry import query
from pressroute.sources.frames import MANIFEST_TYPES

NET = "draw_amount + coalesce(adj_amount, 0) + coalesce(adj_admin_amount, 0) - coalesce(ret_amount, 0)"


@query("project_rename", "", "SELECT s_suppkey AS account_id, s_name AS acct_code, s_nationkey AS owner_id FROM supplier")
def project_rename(t):
    return t.accounts.select("account_id", "acct_code", "owner_id")


@query("searched_case", "manifests", """
    SELECT manifest_id, CASE manifest_type_id WHEN 1 THEN 'Delivery' WHEN 2 THEN 'Collection' WHEN 4 THEN 'Returns' END AS type_name,
           CASE WHEN mfst_code < '3' THEN 'urgent' WHEN mfst_code < '5' THEN 'normal' ELSE 'low' END AS class FROM manifests""")
def searched_case(t):
    code = F.col("mfst_code")
    return t.manifests.select(
        "manifest_id", case_map("manifest_type_id", MANIFEST_TYPES).alias("type_name"),
        F.when(code < "3", "urgent").when(code < "5", "normal").otherwise("low").alias("class"))


@query("optional_filter", "draw_lines", """
    SELECT account_id, CAST(count(*) AS BIGINT) AS n_all,
           CAST(sum(CASE WHEN draw_date >= DATE '1997-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS n_since
    FROM draw_lines GROUP BY account_id""")
def optional_filter(t):
    """The same report with the date argument left out and given."""
    def count(since, name):
        rows = filters.optional_between(filters.optional_eq(t.draw_lines, "account_id", None), "draw_date", since, None)
        return rows.groupBy("account_id").agg(F.count(F.lit(1)).alias(name))
    return count(None, "n_all").join(count("1997-01-01", "n_since"), "account_id")


@query("between_filter", "draw_lines", """
    SELECT CAST(draw_date AS VARCHAR) AS draw_date, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount FROM draw_lines
    WHERE draw_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY draw_date""")
def between_filter(t):
    rows = filters.optional_between(t.draw_lines, "draw_date", "1996-01-01", "1998-12-31")
    return rows.groupBy("draw_date").agg(F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"))


@query("in_list", "draw_lines publications assignments", """
    SELECT pub_type, CAST(count(*) AS BIGINT) AS n FROM draw_lines JOIN publications p USING (publication_id)
    WHERE p.pub_type IN ('ECONOMY', 'STANDARD', 'PROMO')
      AND draw_lines.account_id IN (SELECT account_id FROM assignments WHERE frequency & 1 > 0) GROUP BY pub_type""")
def in_list(t):
    pubs = t.publications.where(F.col("pub_type").isin("ECONOMY", "STANDARD", "PROMO"))
    sunday = t.assignments.where(freq_matches("frequency", 1)).select("account_id").distinct()
    rows = split_join(t.draw_lines, sunday, ["account_id"], "left_semi")
    per_pub = rows.groupBy("publication_id").agg(F.count(F.lit(1)).alias("n"))
    return per_pub.join(pubs, "publication_id").groupBy("pub_type").agg(F.sum("n").alias("n"))


@query("like_filter", "system_log", """
    SELECT CASE WHEN message LIKE 'signup%' THEN 'prefix' WHEN message LIKE '%7}' THEN 'suffix' ELSE 'infix' END AS kind,
           count(*) AS n FROM system_log
    WHERE (message LIKE 'signup%' OR message LIKE '%7}' OR message ILIKE '%CLICK%') AND message NOT LIKE '%"k": 1%' GROUP BY 1""")
def like_filter(t):
    m = F.col("message")
    rows = t.system_log.where((m.like("signup%") | m.like("%7}") | filters.like_any_case("message", "%CLICK%"))
                              & ~m.like('%"k": 1%'))
    kind = F.when(m.like("signup%"), "prefix").when(m.like("%7}"), "suffix").otherwise("infix")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("null_tests", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, ret_amount, ret_export_last FROM draws
    WHERE ret_amount IS DISTINCT FROM ret_export_last AND adj_amount IS NULL AND draw_amount IS NOT NULL""")
def null_tests(t):
    return t.draws.where(null_safe_ne("ret_amount", "ret_export_last") & F.col("adj_amount").isNull()
                         & F.col("draw_amount").isNotNull()).select(
        "account_id", "publication_id", "draw_date", "ret_amount", "ret_export_last")


@query("bitmask_filter", "assignments", """
    SELECT account_id, brand_no, template_id, frequency FROM assignments WHERE frequency & 65 > 0""")
def bitmask_filter(t):
    return t.assignments.where(freq_matches("frequency", 1 | 64)).select("account_id", "brand_no", "template_id", "frequency")


@query("single_bit_check", "assignments", """
    SELECT sequence_id, frequency, count(*) AS items FROM assignments
    WHERE bit_count(frequency) <> 1 GROUP BY sequence_id, frequency""")
def single_bit_check(t):
    return t.assignments.where(not_single_day("frequency")).groupBy("sequence_id", "frequency").agg(
        F.count(F.lit(1)).alias("items"))


@query("time_window_around", "system_log", """
    SELECT log_id, CAST(logged_at AS VARCHAR) AS logged_at, message FROM system_log
    WHERE logged_at BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 13:00:00'""")
def time_window_around(t):
    return t.system_log.where(filters.around("logged_at", "2024-01-15 12:00:00", 60)).select("log_id", "logged_at", "message")


@query("same_day_filter", "system_log", """
    SELECT log_id, message FROM system_log WHERE CAST(logged_at AS DATE) = DATE '2024-01-10'""")
def same_day_filter(t):
    return t.system_log.where(filters.same_day("logged_at", "2024-01-10")).select("log_id", "message")


@query("substring_search", "system_log", """
    SELECT log_id, CAST(logged_at AS VARCHAR) AS logged_at, message FROM system_log
    WHERE contains(message, 'error') AND logged_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
def substring_search(t):
    return filters.search_text(t.system_log, "message", "error", "logged_at", "2024-01-05", "2024-01-25").select(
        "log_id", "logged_at", "message")


@query("computed_predicate", "draws", f"""
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, {NET} AS net FROM draws WHERE {NET} < 0""")
def computed_predicate(t):
    return t.draws.withColumn("net", net_sales()).where("net < 0").select("account_id", "publication_id", "draw_date", "net")
