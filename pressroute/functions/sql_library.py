"""The library's functions for users of SQL: scalar and table functions over views of the canonical tables.

All are SQL functions, so Spark puts their bodies into the plan of the query that calls them: arguments become
filters that reach the scan, and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressroute.functions.bits import DAY_NAMES
from pressroute.sources.frames import MANIFEST_TYPES

_DAYS = ", ".join(f"'{name[:3].upper()}'" for name in DAY_NAMES)
_TYPES = " ".join(f"WHEN {key} THEN '{name}'" for key, name in MANIFEST_TYPES.items())

FUNCTIONS = {
    "day_list": f"""(mask INT) RETURNS STRING
        RETURN CASE WHEN mask IS NOT NULL THEN array_join(filter(transform(
            array({_DAYS}), (name, day) -> if(mask & shiftleft(1, day) > 0, name, NULL)), name -> name IS NOT NULL), ', ') END""",
    "scrub_phone": "(number STRING) RETURNS STRING RETURN translate(number, '-.()', '')",
    "split_text": """(content STRING, separator STRING DEFAULT ',') RETURNS TABLE (pos INT, item STRING)
        RETURN SELECT p + 1, part FROM (SELECT posexplode(split(split_text.content, concat('\\\\Q', split_text.separator, '\\\\E'))) AS (p, part))""",
    "manifest_list": f"""(type_name STRING DEFAULT NULL, acct_code STRING DEFAULT NULL, pub STRING DEFAULT NULL, mask INT DEFAULT NULL)
        RETURNS TABLE (acct_code STRING, pub_short_name STRING, mfst_code STRING, manifest_type STRING, frequency INT)
        RETURN SELECT a.acct_code, s.pub_short_name, concat('MT', lpad(s.template_id, greatest(3, length(s.template_id)), '0')),
                      CASE s.manifest_type_id {_TYPES} END, s.frequency
               FROM assignments s JOIN accounts a ON a.account_id = s.account_id
               WHERE (manifest_list.type_name IS NULL OR CASE s.manifest_type_id {_TYPES} END = manifest_list.type_name)
                 AND (manifest_list.acct_code IS NULL OR a.acct_code = manifest_list.acct_code)
                 AND (manifest_list.pub IS NULL OR s.pub_short_name = manifest_list.pub)
                 AND (manifest_list.mask IS NULL OR s.frequency & manifest_list.mask > 0)""",
    "sales_history": """(on_date DATE) RETURNS TABLE (account_id BIGINT, publication STRING, draw_amount BIGINT, net_1 BIGINT, net_2 BIGINT)
        RETURN WITH n AS (SELECT account_id, publication, draw_date, draw_amount, draw_amount + coalesce(adj_amount, 0) + coalesce(adj_admin_amount, 0)
                                 - coalesce(ret_amount, 0) AS net FROM daily)
        SELECT d.account_id, d.publication, d.draw_amount, a.net, b.net FROM n d
        LEFT JOIN n a ON a.account_id = d.account_id AND a.publication = d.publication AND a.draw_date = date_sub(d.draw_date, 7)
        LEFT JOIN n b ON b.account_id = a.account_id AND b.publication = a.publication AND b.draw_date = date_sub(a.draw_date, 7)
        WHERE d.draw_date = sales_history.on_date""",
}
VIEWS = ("assignments", "accounts", "daily")


def create_functions(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Creates the temporary functions, and the temporary views that they read, in the session. Calling it again replaces them."""
    lacking = sorted(set(VIEWS) - set(views))
    if lacking:
        raise ValueError(f"the functions read views that are not given: {lacking}")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
