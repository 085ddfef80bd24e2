"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pressroute.functions.values import net_sales
from pressroute.operators.sets import diff_tables
from pressroute.plans import load_view
from pressroute.plans.load_view import Field
from pressroute.plans.imports import normalise_load
from pressroute.queries.registry import query
from pressroute.session import shared_folder
from pressroute.sources import files, tables


def _daily_file(t):
    return t.daily.select("account_id", "publication", F.col("draw_date").cast("string").alias("draw_date"),
                          F.col("draw_amount").cast("string").alias("draw_amount"))


@query("read_delimited", "daily", """
    SELECT publication, draw_date, CAST(count(*) AS BIGINT) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount,
           CAST(sum(CASE WHEN account_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_rows
    FROM (SELECT publication, CAST(draw_date AS VARCHAR) AS draw_date, account_id,
                 CASE WHEN account_id % 50 <> 0 THEN draw_amount END AS draw_amount FROM daily)
    GROUP BY publication, draw_date""")
def read_delimited(t):
    """A tab file with a header, where some amounts are no numbers: they land in ``bad_row``."""
    path = shared_folder(t.spark, "delimited")
    broken = F.when(F.col("account_id") % 50 == 0, "n/a").otherwise(F.col("draw_amount"))
    files.export_delimited(_daily_file(t).withColumn("draw_amount", broken), path, sep="\t")
    schema = StructType([StructField("account_id", LongType()), StructField("publication", StringType()),
                         StructField("draw_date", StringType()), StructField("draw_amount", IntegerType())])
    return files.read_delimited(t.spark, path, schema).groupBy("publication", "draw_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"),
        F.count_if(F.col("bad_row").isNotNull()).alias("bad_rows"))


@query("read_weblog", "weblog", """
    SELECT page, query, count(*) AS hits, CAST(min(logged_at) AS DATE)::VARCHAR AS first_date
    FROM weblog GROUP BY page, query""")
def read_weblog(t):
    path = shared_folder(t.spark, "weblog")
    line = F.concat_ws(" ", F.date_format("logged_at", "yyyy-MM-dd"), F.date_format("logged_at", "HH:mm:ss"),
                       F.lit("GET"), "page", "query", F.lit("-"))
    header = tables.inline_rows(t.spark, [("#Fields: date time method page query user",)], "value string")
    t.weblog.select(line.alias("value")).unionByName(header).write.text(path)
    log = files.read_weblog(t.spark, path, ["date", "time", "method", "page", "query", "user"])
    return log.where("user is null").groupBy("page", "query").agg(
        F.count(F.lit(1)).alias("hits"), F.min("date").alias("first_date"))


LAYOUT = [("account_id", 1, 10), ("publication", 11, 12), ("draw_date", 23, 10), ("draw_amount", 33, 8)]


@query("read_fixed_layout", "daily", """
    SELECT CAST(account_id AS VARCHAR) AS account_id, publication, count(*) AS days,
           CAST(sum(draw_amount) AS BIGINT) AS draw_amount
    FROM daily GROUP BY account_id, publication""")
def read_fixed_layout(t):
    path = shared_folder(t.spark, "fixed")
    files.write_fixed(_daily_file(t), path, LAYOUT)
    return files.read_fixed(t.spark, path, LAYOUT).groupBy("account_id", "publication").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("draw_amount").cast("bigint")).alias("draw_amount"))


@query("scan_table", "", """
    SELECT CAST(s_nationkey AS BIGINT) AS owner_id, count(*) AS accounts FROM supplier GROUP BY s_nationkey""")
def scan_table(t):
    return tables.scan(t.spark, "supplier", t.base).groupBy(
        F.col("s_nationkey").cast("bigint").alias("owner_id")).agg(F.count(F.lit(1)).alias("accounts"))


def _restored_copy(t):
    """A second base path with a copy of the publications, as from a restored backup."""
    base = shared_folder(t.spark, "restored")
    copy = t.table("part").where("p_size <> 7").withColumn(
        "p_name", F.when(F.col("p_size") == 9, F.upper("p_name")).otherwise(F.col("p_name")))
    copy.write.parquet(f"{base}/part.parquet")
    return base


@query("scan_cross_catalog", "", """
    SELECT p_partkey, p_name AS left_p_name,
           CASE WHEN p_size = 7 THEN NULL WHEN p_size = 9 THEN upper(p_name) ELSE p_name END AS right_p_name,
           CASE WHEN p_size = 7 THEN 'left only' WHEN p_size = 9 THEN 'changed' ELSE 'same' END AS status
    FROM part""")
def scan_cross_catalog(t):
    other = tables.scan(t.spark, "part", _restored_copy(t))
    return diff_tables(t.table("part"), other, ["p_partkey"], ["p_name"])


@query("union_over_catalogs", "", """
    SELECT 'main' AS company, p_brand AS brand, count(*) AS publications FROM part GROUP BY p_brand
    UNION ALL SELECT 'copy', p_brand, count(*) FROM part WHERE p_size <> 7 GROUP BY p_brand""")
def union_over_catalogs(t):
    return tables.union_over(
        {"main": t.base, "copy": _restored_copy(t)},
        lambda base: tables.scan(t.spark, "part", base).groupBy(F.col("p_brand").alias("brand")).agg(
            F.count(F.lit(1)).alias("publications")))


@query("normalise_view", "load", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, draw_weekday, draw_amount,
           CAST(draw_rate AS DOUBLE) AS draw_rate FROM load""")
def normalise_view(t):
    return normalise_load(t.load_raw).drop("delivery_date")


def _checked_load(t):
    """The canonical view of the circulation system's file: rows to load, and rejects."""
    fields = load_view.standard_fields({
        "drawdate": Field("drawdate", ("rundate",), None, "date", "MM/dd/yyyy", required=True),
        "deliverydate": Field("deliverydate", ("rundate",), None, "date", "MM/dd/yyyy"),
        "drawamount": Field("drawamount", ("drawtotal",), 0, "int"),
        "publication": Field("publication", ("productid",), longest=40, required=True, codes="publications"),
        "drawrate": Field("drawrate", ("rate",), 0, "decimal(8,5)"),
        "mfstname": Field("mfstname", ("truckname", "truckid")), "mfstcode": Field("mfstcode", ("truckid",)),
        "acctcode": Field("acctcode", ("routeid",), required=True, codes="accounts"),
        "acctaddress": Field("acctaddress", ("dropinstructions",), longest=128),
        "dropsequence": Field("dropsequence", ("truckdroporder",)),
    })
    view = load_view.read_by(t.manifest_file, fields, {"accounts": t.account_codes, "publications": t.publication_codes}, keep=["file_order", "file_line"])
    return load_view.write_checked(view, shared_folder(t.spark, "load-view"))


ACCOUNT_SQL = "'A' || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0')"
GOOD_SQL = "l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0 AND l_orderkey % 79 <> 0 AND l_orderkey % 83 <> 0"
READ_SQL = {
    "drawdate": "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)", "deliverydate": "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)", "drawamount": "CAST(l_quantity AS INTEGER)",
    "publication": "CASE WHEN l_orderkey % 2 = 0 THEN 'P' ELSE 'p' END || l_partkey", "drawrate": "CAST(CAST(l_tax AS DECIMAL(8,5)) AS DOUBLE)",
    "mfstname": "CASE WHEN l_orderkey % 5 = 0 THEN 'Truck ' ELSE 'T' END || l_orderkey % 40", "mfstcode": "'T' || l_orderkey % 40",
    "acctcode": f"CASE WHEN l_orderkey % 3 = 0 THEN lower({ACCOUNT_SQL}) ELSE {ACCOUNT_SQL} END", "acctaddress": "'Stop ' || l_linenumber",
    "dropsequence": "CAST(l_linenumber AS VARCHAR)"}
VIEW_SQL = ", ".join(f"{READ_SQL.get(name) or ('NULL' if default is None else repr(default))} AS {name}" for name, default in load_view.STANDARD.items())


@query("load_view", "", f"""
    SELECT l_orderkey AS file_order, l_linenumber AS file_line, l_partkey AS publication_id, l_suppkey AS acctcode_id, {VIEW_SQL}
    FROM lineitem WHERE {GOOD_SQL}""")
def load_view_rows(t):
    """All columns of the canonical load view, read by a mapping, with codes resolved in either case."""
    return _checked_load(t)[0]


@query("load_view_rejects", "", f"""
    SELECT l_orderkey AS file_order, l_linenumber AS file_line, concat_ws('; ',
           CASE WHEN l_orderkey % 97 = 0 THEN 'drawdate: cannot read 13/45/1999; deliverydate: cannot read 13/45/1999' END,
           CASE WHEN l_orderkey % 89 = 0 THEN 'drawamount: cannot read many' END, CASE WHEN l_orderkey % 79 = 0 THEN 'publication: missing' END,
           CASE WHEN l_orderkey % 83 = 0 THEN 'acctcode: unknown code X' || {ACCOUNT_SQL} END) AS faults
    FROM lineitem WHERE NOT ({GOOD_SQL})""")
def load_view_rejects(t):
    """One row for each row of the file that cannot be loaded, with all its faults."""
    return _checked_load(t)[1].select("file_order", "file_line", F.concat_ws("; ", "faults").alias("faults"))


@query("values_list", "accounts account_types", """
    SELECT type_name, count(*) AS accounts FROM accounts JOIN account_types USING (account_type_id) GROUP BY type_name""")
def values_list(t):
    return t.accounts.join(t.account_types, "account_type_id").groupBy("type_name").agg(F.count(F.lit(1)).alias("accounts"))


@query("sink_table", "default_draws", """
    SELECT draw_weekday, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount,
           '2024-02-01 06:00:00' AS snapshot_taken FROM default_draws GROUP BY draw_weekday""")
def sink_table(t):
    base = shared_folder(t.spark, "snapshots")
    tables.write_snapshot(t.default_draws, base, "20240201060000")
    return tables.snapshots(t.spark, base).groupBy("draw_weekday", "snapshot_taken").agg(
        F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"))


@query("sink_append", "daily", """
    SELECT publication, 2 * count(*) AS n, CAST(2 * sum(draw_amount) AS BIGINT) AS draw_amount FROM daily GROUP BY publication""")
def sink_append(t):
    path = shared_folder(t.spark, "append")
    tables.append(t.daily, path)
    tables.append(t.daily, path)
    return t.spark.read.parquet(path).groupBy("publication").agg(
        F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"))


@query("export_delimited", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date,
           draw_amount + coalesce(adj_amount, 0) + coalesce(adj_admin_amount, 0) - coalesce(ret_amount, 0) AS net FROM draws""")
def export_delimited(t):
    path = shared_folder(t.spark, "export")
    files.export_delimited(t.draws.select("account_id", "publication_id", "draw_date", net_sales().alias("net")), path)
    return t.spark.read.option("sep", "|").option("header", True).schema(
        "account_id bigint, publication_id bigint, draw_date date, net bigint").csv(path)


@query("export_per_key", "draw_lines publications", """
    SELECT pub_short_name, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount
    FROM draw_lines JOIN publications USING (publication_id) GROUP BY pub_short_name""")
def export_per_key(t):
    path = shared_folder(t.spark, "per-publication")
    rows = t.draw_lines.join(t.publications.select("publication_id", "pub_short_name"), "publication_id")
    files.export_partitioned(rows.select("pub_short_name", "account_id", "draw_date", "draw_amount"), "pub_short_name", path)
    return t.spark.read.option("header", True).schema(
        "account_id bigint, draw_date date, draw_amount int, pub_short_name string").csv(path).groupBy(
        "pub_short_name").agg(F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"))


@query("snapshot_union_view", "default_draws", """
    SELECT account_id, publication_id, draw_weekday, draw_amount AS first_amount,
           CASE WHEN draw_weekday <> 1 THEN draw_amount + 1 END AS second_amount FROM default_draws""")
def snapshot_union_view(t):
    """Two dated snapshots read as one table, then compared per key."""
    base = shared_folder(t.spark, "snapshots")
    keys = ["account_id", "publication_id", "draw_weekday"]
    rows = t.default_draws.select(*keys, "draw_amount")
    tables.write_snapshot(rows, base, "20240201060000")
    tables.write_snapshot(rows.where("draw_weekday <> 1").withColumn("draw_amount", F.col("draw_amount") + 1), base, "20240202060000")
    taken = F.to_date("snapshot_taken")
    return tables.snapshots(t.spark, base).groupBy(*keys).agg(
        F.max(F.when(taken == "2024-02-01", F.col("draw_amount"))).alias("first_amount"),
        F.max(F.when(taken == "2024-02-02", F.col("draw_amount"))).alias("second_amount"))
