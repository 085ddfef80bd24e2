"""Functions called from SQL, and codes compared without regard to case and trailing blanks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.sql_library import VIEWS, create_functions
from pressroute.operators import collation
from pressroute.plans import procedures
from pressroute.queries.q01_sources import ACCOUNT_SQL
from pressroute.queries.registry import ORACLE, query


def same_as(other: str):
    """Registers a query under its function's name with the SQL that checks another one."""
    def register(fn):
        query(fn.__name__)(fn)
        ORACLE[fn.__name__] = ORACLE[other]
        return fn
    return register


def _sql(t, text: str):
    create_functions(t.spark, {name: getattr(t, name) for name in VIEWS})
    return t.spark.sql(text)


@same_as("udf_scalar_text")
def sql_udf_scalar(t):
    return _sql(t, """
        SELECT acct_code, scrub_phone(acct_code) AS phone, array_join(sort_array(collect_set(mfst_code)), ';') AS manifests,
               day_list(mask => bit_or(frequency)) AS days FROM manifest_list() GROUP BY acct_code""")


@same_as("udtf_filtered")
def sql_udtf_filtered(t):
    """The manifest list called with no argument, and with a type and a day by name."""
    return _sql(t, """
        SELECT 'all' AS call, acct_code, pub_short_name, mfst_code, frequency FROM manifest_list()
        UNION ALL SELECT 'delivery on sunday', acct_code, pub_short_name, mfst_code, frequency FROM manifest_list(mask => 1, type_name => 'Delivery')""")


@same_as("udtf_history")
def sql_udtf_history(t):
    return _sql(t, "SELECT * FROM sales_history(DATE '2024-01-24')")


@same_as("udtf_split")
def sql_udtf_split(t):
    t.table("conversations").createOrReplaceTempView("conversations")
    return _sql(t, "SELECT conv_id, turn, pos, item FROM conversations, LATERAL split_text(text, separator => '. ')")


@query("join_collated", "", f"""
    SELECT l_suppkey AS id, {ACCOUNT_SQL} AS code, count(*) AS file_rows FROM lineitem WHERE l_orderkey % 83 <> 0 GROUP BY ALL""")
def join_collated(t):
    """Rows of the file by account: its codes come in either case and padded."""
    file = collation.as_codes(t.manifest_file.select(F.col("routeid").alias("code")), "code")
    joined = file.join(collation.as_codes(t.account_codes, "code"), "code")
    return joined.groupBy("id").agg(F.count(F.lit(1)).alias("file_rows")).join(t.account_codes, "id").select("id", "code", "file_rows")


@query("group_collated", "", """
    SELECT CASE WHEN l_orderkey % 79 = 0 THEN '' ELSE 'p' || l_partkey END AS code, count(*) AS file_rows FROM lineitem GROUP BY ALL""")
def group_collated(t):
    """Rows by publication code, whatever its spelling."""
    codes = collation.as_codes(t.manifest_file.select(F.col("productid").alias("code")), "code")
    return collation.plain(codes.groupBy("code").agg(F.count(F.lit(1)).alias("file_rows")), "code")


@query("filter_collated", "", f"""
    WITH f AS (SELECT l_orderkey AS file_order, l_linenumber AS file_line, CASE WHEN l_orderkey % 83 = 0 THEN 'XA' || substr({ACCOUNT_SQL}, 2)
                      WHEN l_orderkey % 3 = 0 THEN lower({ACCOUNT_SQL}) ELSE {ACCOUNT_SQL} END || '  ' AS routeid,
                      CASE WHEN l_orderkey % 79 = 0 THEN '' ELSE 'P' || l_partkey END AS pub FROM lineitem)
    SELECT file_order, file_line, regexp_replace(routeid, '[aA]0', '-', 'g') AS route FROM f
    WHERE routeid ILIKE 'xa%' OR pub IN ('P1', 'P2', 'P3')""")
def filter_collated(t):
    """LIKE, IN and REPLACE that take either case; trailing blanks of a code do not count."""
    wanted = collation.like_code("routeid", "xa%") | F.collate("productid", collation.CODES).isin("P1 ", "p2", "P3")
    return t.manifest_file.where(wanted).select("file_order", "file_line", collation.replace_text("routeid", "a0", "-").alias("route"))


TOTALS = """
    SELECT s.template_id, sum(d.draw_amount) AS draw_amount FROM report_draws d JOIN report_publications p ON p.publication_id = d.publication_id
    JOIN assignments s ON s.account_id = d.account_id AND s.brand_no = p.brand_no AND s.frequency & shiftleft(1, d.draw_weekday - 1) > 0
    WHERE d.draw_date BETWEEN ? AND ? GROUP BY s.template_id"""


@query("proc_report_dated", "draw_lines publications assignments", """
    SELECT s.template_id, CAST(sum(d.draw_amount) AS BIGINT) AS draw_amount FROM draw_lines d JOIN publications p USING (publication_id)
    JOIN assignments s ON s.account_id = d.account_id AND s.brand_no = p.brand_no AND s.frequency & (1 << (d.draw_weekday - 1)) > 0
    WHERE d.draw_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY s.template_id""")
def proc_report_dated(t):
    """A procedure of two dates, run for one year and then for another: the second result stands in place of the first."""
    for name in ("draw_lines", "publications"):
        getattr(t, name).createOrReplaceTempView({"draw_lines": "report_draws"}.get(name, f"report_{name}"))
    t.assignments.createOrReplaceTempView("assignments")
    for year in (1995, 1996):
        report = procedures.run_procedure(t.spark, "draw_totals", TOTALS, {
            "first_date": ("DATE", f"{year}-01-01"), "last_date": ("DATE", f"{year}-12-31")})
    return report
