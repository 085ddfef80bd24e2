"""Arithmetic, bits, casts, nulls, type tests, rendered text, and the function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions import bits, dates as d, text as x, values as v
from pressroute.operators import changes
from pressroute.operators.aggregates import csv_agg
from pressroute.plans import sales, schedules
from pressroute.plans.fixtures import random_returns
from pressroute.queries.registry import query
from pressroute.queries.q02_filters import NET
from pressroute.queries.q08_dates import DAY_LIST
from pressroute.sources import tables
from pressroute.session import shared_folder

TEMPLATE = "'MT' || lpad(CAST(template_id AS VARCHAR), CAST(greatest(3, length(CAST(template_id AS VARCHAR))) AS INTEGER), '0')"


@query("arith", "draw_lines", """
    SELECT account_id, order_key, line_no, publication_id, draw_amount * 3 - 7 AS scaled, draw_amount // 6 AS packs, draw_amount % 6 AS loose
    FROM draw_lines""")
def arith(t):
    q = F.col("draw_amount")
    return t.draw_lines.select("account_id", "order_key", "line_no", "publication_id", (q * 3 - 7).alias("scaled"),
                               v.int_div(q, F.lit(6)).alias("packs"), (q % 6).alias("loose"))


@query("math_power_floor", "assignments", """
    SELECT account_id, brand_no, sequence_id, CAST(pow(2, brand_no % 7) AS BIGINT) AS bit, CAST(floor(sequence / 7.0) AS BIGINT) AS row_no FROM assignments""")
def math_power_floor(t):
    return t.assignments.select("account_id", "brand_no", "sequence_id", F.pow(F.lit(2), F.col("brand_no") % 7).cast("bigint").alias("bit"),
                                F.floor(F.col("sequence") / 7).alias("row_no"))


@query("math_rand", "draw_lines", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, line_no, order_key,
           CAST('0x' || substr(md5('42|' || order_key || '|' || line_no), 1, 8) AS BIGINT) % (draw_amount + 1) AS returned FROM draw_lines""")
def math_rand(t):
    """Seeded random share of each draw line, from a hash of seed and key: the same on any partitioning."""
    rows = random_returns(t.draw_lines, ["order_key", "line_no"], "draw_amount", 42, "returned")
    return rows.select("account_id", "publication_id", "draw_date", "line_no", "order_key", "returned")


@query("bit_ops", "assignments", """
    SELECT account_id, brand_no, CAST(bit_or(frequency) AS INTEGER) AS any_day, CAST(bit_and(frequency) AS INTEGER) AS every_day,
           CAST(max(CAST((frequency & 1 > 0) OR (frequency & 64 > 0) AS INTEGER)) AS INTEGER) AS weekend FROM assignments GROUP BY account_id, brand_no""")
def bit_ops(t):
    weekend = bits.freq_matches("frequency", 1).cast("int").bitwiseOR(bits.freq_matches("frequency", 64).cast("int"))
    return t.assignments.groupBy("account_id", "brand_no").agg(
        F.bit_or("frequency").alias("any_day"), F.bit_and("frequency").alias("every_day"), F.max(weekend).alias("weekend"))


@query("cast_types", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, CAST(CAST(draw_rate AS DECIMAL(19,4)) AS DOUBLE) AS money,
           CAST(draw_amount AS VARCHAR) AS text_amount, CAST(CAST(draw_amount AS DECIMAL(18,0)) AS DOUBLE) AS whole, CAST(draw_amount > 25 AS INTEGER) AS big
    FROM draws""")
def cast_types(t):
    return t.draws.select("account_id", "publication_id", "draw_date", F.col("draw_rate").cast("decimal(19,4)").alias("money"),
                          F.col("draw_amount").cast("string").alias("text_amount"), F.col("draw_amount").cast("decimal(18,0)").alias("whole"),
                          (F.col("draw_amount") > 25).cast("int").alias("big"))


@query("null_funcs", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(ret_amount, 0) AS ret,
           coalesce(adj_amount, adj_admin_amount, -1) AS first_adj, nullif(draw_amount, 25) AS not_25 FROM draws""")
def null_funcs(t):
    return t.draws.select("account_id", "publication_id", "draw_date", v.zero("ret_amount").alias("ret"),
                          F.coalesce("adj_amount", "adj_admin_amount", F.lit(-1)).alias("first_adj"),
                          F.nullif("draw_amount", F.lit(25)).alias("not_25"))


@query("type_tests", "system_log", """
    SELECT log_id, CAST(TRY_CAST(split_part(message, ' ', 3) AS DECIMAL(38,10)) IS NOT NULL AS INTEGER) AS third_is_number,
           CAST(TRY_CAST(replace(split_part(message, ' ', 3), '}', '') AS DECIMAL(38,10)) IS NOT NULL AS INTEGER) AS digits_are_number,
           CAST(log_id % 3 <> 0 AS INTEGER) AS is_date FROM system_log""")
def type_tests(t):
    third = x.token("message", " ", 3)
    stamp = F.when(F.col("log_id") % 3 == 0, F.lit("2024-13-45")).otherwise(F.date_format("logged_at", "yyyy-MM-dd"))
    return t.system_log.select("log_id", v.is_numeric(third).cast("int").alias("third_is_number"),
                               v.is_numeric(F.replace(third, F.lit("}"), F.lit(""))).cast("int").alias("digits_are_number"),
                               v.is_date(stamp).cast("int").alias("is_date"))


@query("sql_text_gen", "draws", """
    SELECT 'update draws set ret_amount = ' || coalesce('''' || ret_amount || '''', 'NULL') || ' where account_id = ''' || account_id
           || ''' and publication_id = ''' || publication_id || ''' and draw_date = ''' || CAST(draw_date AS VARCHAR) || '''' AS undo FROM draws""")
def sql_text_gen(t):
    """One undo statement per row, as text."""
    return t.draws.select(F.concat(
        F.lit("update draws set ret_amount = "), x.sql_literal("ret_amount"), F.lit(" where account_id = "), x.sql_literal("account_id"),
        F.lit(" and publication_id = "), x.sql_literal("publication_id"), F.lit(" and draw_date = "), x.sql_literal("draw_date")).alias("undo"))


@query("udf_scalar_text", "assignments accounts", f"""
    SELECT acct_code, replace(replace(acct_code, '-', ''), '.', '') AS phone, string_agg(DISTINCT {TEMPLATE}, ';' ORDER BY {TEMPLATE}) AS manifests,
           {DAY_LIST.format(f="bit_or(frequency)")} AS days FROM assignments JOIN accounts USING (account_id) GROUP BY acct_code""")
def udf_scalar_text(t):
    """Day list, phone scrub and manifest list of an account, all as column expressions."""
    lists = t.assignments.withColumn("code", schedules.template_code()).groupBy("account_id").agg(
        F.array_join(F.sort_array(F.collect_set("code")), ";").alias("manifests"), F.bit_or("frequency").alias("mask"))
    return lists.join(t.accounts, "account_id").select("acct_code", x.scrub_phone("acct_code").alias("phone"), "manifests",
                                                       bits.day_list("mask").alias("days"))


@query("udf_scalar_date", "manifests", """
    SELECT manifest_id, CAST(manifest_date - CAST(extract(dow FROM manifest_date) AS INTEGER) + 1 + 9 AS VARCHAR) AS next_wednesday FROM manifests""")
def udf_scalar_date(t):
    return t.manifests.select("manifest_id", d.next_named_day("Wednesday", "manifest_date").alias("next_wednesday"))


@query("udtf_filtered", "assignments accounts", f"""
    SELECT 'all' AS call, acct_code, pub_short_name, {TEMPLATE} AS mfst_code, frequency FROM assignments JOIN accounts USING (account_id)
    UNION ALL SELECT 'delivery on sunday', acct_code, pub_short_name, {TEMPLATE}, frequency FROM assignments JOIN accounts USING (account_id)
    WHERE manifest_type_id = 1 AND frequency & 1 > 0""")
def udtf_filtered(t):
    """The manifest list with its arguments left out, and with a type and a day given."""
    def call(name, **arguments):
        rows = schedules.manifest_assignments(t.assignments, t.accounts, **arguments)
        return rows.select(F.lit(name).alias("call"), "acct_code", "pub_short_name", "mfst_code", "frequency")
    return call("all").unionByName(call("delivery on sunday", type_name="Delivery", mask=1))


@query("udtf_history", "daily", f"""
    WITH n AS (SELECT account_id, publication, draw_date, draw_amount, {NET} AS net FROM daily)
    SELECT d.account_id, d.publication, d.draw_amount, a.net AS net_1, b.net AS net_2 FROM n d
    LEFT JOIN n a ON a.account_id = d.account_id AND a.publication = d.publication AND a.draw_date = d.draw_date - 7
    LEFT JOIN n b ON b.account_id = a.account_id AND b.publication = a.publication AND b.draw_date = a.draw_date - 7
    WHERE d.draw_date = DATE '2024-01-24'""")
def udtf_history(t):
    """Sales history of one date, two weeks back."""
    return sales.sales_history(t.daily, ["account_id", "publication"], "2024-01-24", 2).select(
        "account_id", "publication", "draw_amount", "net_1", "net_2")


@query("udtf_split", "", """
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, item FROM (
        SELECT conv_id, turn, unnest(string_split(text, '. ')) AS item, unnest(range(1, len(string_split(text, '. ')) + 1)) AS pos FROM conversations)""")
def udtf_split(t):
    return x.split_rows(t.table("conversations"), "text", ". ").select("conv_id", "turn", "pos", "item")


@query("udtf_dates", "manifests", """
    SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS manifests
    FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '1997-02-01', INTERVAL 1 DAY)) AS DATE) AS day)
    LEFT JOIN (SELECT manifest_date AS day, count(*) AS n FROM manifests GROUP BY 1) USING (day)""")
def udtf_dates(t):
    per_day = t.manifests.groupBy(F.col("manifest_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.date_spine(t.spark, "1996-02-01", "1997-02-01", "1 day", "day").join(per_day, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("manifests"))


@query("proc_report", "draw_lines publications assignments", """
    SELECT s.template_id, CAST(sum(d.draw_amount) AS BIGINT) AS draw_amount FROM draw_lines d JOIN publications p USING (publication_id)
    JOIN assignments s ON s.account_id = d.account_id AND s.brand_no = p.brand_no AND s.frequency & (1 << (d.draw_weekday - 1)) > 0 GROUP BY s.template_id""")
def proc_report(t):
    """A report written to a table, then summed from there."""
    path = shared_folder(t.spark, "report")
    tables.append(schedules.net_by_manifest(t.draw_lines, t.publications, t.assignments), path)
    return t.spark.read.parquet(path).groupBy("template_id").agg(F.sum("draw_amount").alias("draw_amount"))


@query("table_type_param", "account_pubs accounts", """
    SELECT account_id, publication_id FROM account_pubs WHERE account_id NOT IN (SELECT account_id FROM accounts WHERE active = 0)""")
def table_type_param(t):
    """Keys handed over as a table."""
    doomed = t.accounts.where("active = 0").select("account_id")
    return changes.delete_keys(t.account_pubs, doomed, ["account_id"]).select("account_id", "publication_id")


@query("udaf_none", "manifests", """
    SELECT owner_id, string_agg(DISTINCT mfst_code, ', ' ORDER BY mfst_code) AS codes FROM manifests GROUP BY owner_id""")
def udaf_none(t):
    """Text aggregation by a built-in set, the only aggregate the original reports made themselves."""
    return csv_agg(t.manifests, ["owner_id"], "mfst_code", name="codes")
