"""Table changes as new tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.operators import changes, sets
from pressroute.plans import accounts as accts, imports, schedules
from pressroute.plans.fixtures import random_adjustments, random_returns
from pressroute.queries.q04_aggregates import TEMPLATE
from pressroute.queries.registry import query
from pressroute.session import shared_folder
from pressroute.sources import tables
from pressroute.sources.frames import DAILY_KEY, DRAW_KEY

VALUES = ["draw_amount", "draw_rate"]
AT = "2002-01-01 03:00:00"


def _at():
    return F.lit(AT).cast("timestamp_ntz")


@query("update_from", "load load_base", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(l.draw_amount, b.draw_amount) AS draw_amount,
           CAST(coalesce(l.draw_rate, b.draw_rate) AS DOUBLE) AS draw_rate FROM load_base b LEFT JOIN load l USING (account_id, publication_id, draw_date)""")
def update_from(t):
    return changes.apply_updates(t.load_base, t.load, DRAW_KEY, VALUES)


@query("update_with_history", "load load_base", f"""
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, '{AT}' AS changed_at, 1 AS change_type_id,
           b.draw_amount AS old_draw_amount, l.draw_amount AS new_draw_amount, CAST(b.draw_rate AS DOUBLE) AS old_draw_rate,
           CAST(l.draw_rate AS DOUBLE) AS new_draw_rate
    FROM load_base b JOIN load l USING (account_id, publication_id, draw_date) WHERE b.draw_amount <> l.draw_amount OR b.draw_rate <> l.draw_rate""")
def update_with_history(t):
    table, history = changes.apply_with_history(t.load_base, t.load, DRAW_KEY, VALUES, _at(), 1)
    return history


@query("upsert_import", "load load_base", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(l.draw_amount, b.draw_amount) AS draw_amount,
           CAST(coalesce(l.draw_rate, b.draw_rate) AS DOUBLE) AS draw_rate
    FROM load_base b FULL JOIN load l USING (account_id, publication_id, draw_date)""")
def upsert_import(t):
    return imports.import_draws(t.load_base, t.load, t.default_draws, DRAW_KEY, _at(), 1)["table"]


@query("upsert_import_history", "load load_base", f"""
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, '{AT}' AS changed_at, 1 AS change_type_id,
           CASE WHEN b.draw_amount IS NULL THEN 'insert' ELSE 'update' END AS action, coalesce(b.draw_amount, l.draw_amount) AS old_draw_amount,
           l.draw_amount AS new_draw_amount, CAST(coalesce(b.draw_rate, l.draw_rate) AS DOUBLE) AS old_draw_rate, CAST(l.draw_rate AS DOUBLE) AS new_draw_rate
    FROM load l LEFT JOIN load_base b USING (account_id, publication_id, draw_date)
    WHERE b.draw_amount IS NULL OR b.draw_amount <> l.draw_amount OR b.draw_rate <> l.draw_rate""")
def upsert_import_history(t):
    return imports.import_draws(t.load_base, t.load, t.default_draws, DRAW_KEY, _at(), 1)["history"]


DEFAULTS_SQL = """newest AS (SELECT account_id, publication_id, draw_weekday, arg_max(draw_amount, draw_date) AS new_amount, arg_max(draw_rate, draw_date) AS new_rate
        FROM load GROUP BY 1, 2, 3),
    template AS (SELECT * FROM default_draws WHERE allow_forecasting = 1)"""


@query("import_defaults", "load default_draws", f"""
    WITH {DEFAULTS_SQL}
    SELECT account_id, publication_id, draw_weekday, CAST(coalesce(new_amount, draw_amount) AS BIGINT) AS draw_amount,
           CAST(coalesce(new_rate, draw_rate) AS DOUBLE) AS draw_rate
    FROM template FULL JOIN newest USING (account_id, publication_id, draw_weekday)""")
def import_defaults(t):
    """The weekday template after the load; rows that may not be forecast stand for pairs the template lacks."""
    return _import_defaults(t)["table"]


def _import_defaults(t):
    template = t.default_draws.where("allow_forecasting = 1").withColumn("draw_amount", F.col("draw_amount").cast("bigint"))
    existing = template.where("draw_amount % 4 = 0").select(
        "account_id", "publication_id", "draw_weekday", F.expr("draw_amount div 4").alias("version"))
    return imports.import_defaults(template, t.load, existing, _at())


@query("import_defaults_history", "load default_draws", f"""
    WITH {DEFAULTS_SQL}
    SELECT account_id, publication_id, draw_weekday, CASE WHEN draw_amount IS NULL THEN 'insert' ELSE 'update' END AS action,
           '{AT}' AS changed_at, 1 AS change_type_id, CAST(coalesce(draw_amount, 0) AS BIGINT) AS old_draw_amount, new_amount AS new_draw_amount,
           CAST(coalesce(draw_rate, 0) AS DOUBLE) AS old_draw_rate, CAST(new_rate AS DOUBLE) AS new_draw_rate,
           CAST(1 + CASE WHEN draw_amount % 4 = 0 THEN draw_amount // 4 ELSE 0 END AS BIGINT) AS version
    FROM newest LEFT JOIN template USING (account_id, publication_id, draw_weekday)
    WHERE draw_amount IS NULL OR draw_amount <> new_amount OR draw_rate <> new_rate""")
def import_defaults_history(t):
    return _import_defaults(t)["history"]


@query("import_duplicates", "draw_lines", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, count(*) - 1 AS removed FROM draw_lines
    GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def import_duplicates(t):
    """Keys that a file holds more than once, with the number of rows that are not loaded."""
    rows = t.draw_lines.select(*DRAW_KEY, "draw_amount", "draw_rate", "order_key", "line_no")
    return imports.split_repeated(rows, DRAW_KEY)[1]


@query("import_filled", "daily", """
    WITH base AS (SELECT account_id, publication, draw_date, draw_weekday, draw_amount FROM daily WHERE account_id % 3 <> 0),
    file AS (SELECT account_id, publication, draw_date, draw_amount + 1 AS draw_amount FROM daily WHERE account_id % 3 <> 1 AND draw_weekday IN (1, 2)),
    defaults AS (SELECT account_id, publication, draw_weekday, max(draw_amount) AS draw_amount FROM daily GROUP BY 1, 2, 3),
    loaded AS (SELECT account_id, publication, draw_date, coalesce(f.draw_amount, b.draw_amount) AS draw_amount
               FROM base b FULL JOIN file f USING (account_id, publication, draw_date)),
    due AS (SELECT account_id, publication, draw_date, d.draw_amount FROM defaults d
            JOIN (SELECT DISTINCT draw_date, CAST(extract(dow FROM draw_date) + 1 AS INTEGER) AS draw_weekday FROM file) USING (draw_weekday))
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, CAST(draw_amount AS BIGINT) AS draw_amount FROM loaded
    UNION ALL SELECT account_id, publication, CAST(draw_date AS VARCHAR), CAST(draw_amount AS BIGINT) FROM due
    WHERE NOT EXISTS (SELECT 1 FROM loaded l WHERE l.account_id = due.account_id AND l.publication = due.publication AND l.draw_date = due.draw_date)""")
def import_filled(t):
    """A load of two weekdays into a table, with the pairs that are due on its dates and absent filled in."""
    daily = t.daily.withColumnRenamed("publication", "publication_id").withColumn("draw_rate", F.lit(0).cast("decimal(8,5)"))
    file = daily.where("account_id % 3 <> 1 and draw_weekday in (1, 2)").withColumn("draw_amount", F.col("draw_amount") + 1).withColumn(
        "delivery_date", F.col("draw_date"))
    defaults = daily.groupBy("account_id", "publication_id", "draw_weekday").agg(
        F.max("draw_amount").alias("draw_amount"), F.max("draw_rate").alias("draw_rate"))
    out = imports.import_draws(daily.where("account_id % 3 <> 0"), file, defaults, DRAW_KEY, _at(), 1, fill=True)["table"]
    return out.select("account_id", F.col("publication_id").alias("publication"), "draw_date", "draw_amount")


@query("load_rejects", "load", """
    SELECT DISTINCT 'A' || lpad(CAST(account_id AS VARCHAR), CAST(greatest(6, length(CAST(account_id AS VARCHAR))) AS INTEGER), '0') AS code,
           CASE account_id % 3 WHEN 0 THEN 'draw_date' WHEN 1 THEN 'draw_amount' ELSE 'acct_code' END AS faults
    FROM load WHERE account_id % 10 = 0""")
def load_rejects(t):
    """Rows that cannot be read, here every tenth account's, made from good ones, with the column at fault."""
    number = F.substr(F.trim("acct_code"), F.lit(2)).cast("bigint")
    raw = t.load_raw.withColumn("kind", F.when(number % 10 == 0, number % 3))
    bad = raw.withColumns({"draw_date": F.when(F.col("kind") == 0, "13/45/1999").otherwise(F.col("draw_date")),
                           "draw_amount": F.when(F.col("kind") == 1, "many").otherwise(F.col("draw_amount")),
                           "acct_code": F.when(F.col("kind") == 2, F.concat(F.trim("acct_code"), F.lit("x"))).otherwise(F.trim("acct_code"))})
    return imports.load_rejects(bad).select(F.rtrim("acct_code", F.lit("x")).alias("code"), "faults").distinct()


@query("upsert_import_missing", "daily", """
    WITH defaults AS (SELECT account_id, publication, draw_weekday, max(draw_amount) AS draw_amount FROM daily GROUP BY 1, 2, 3),
    dates AS (SELECT DISTINCT draw_date, draw_weekday FROM daily)
    SELECT account_id, publication, draw_weekday, d.draw_amount, CAST(draw_date AS VARCHAR) AS draw_date, 0.0::DOUBLE AS draw_rate
    FROM defaults d JOIN dates USING (draw_weekday)
    WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.account_id = d.account_id AND x.publication = d.publication AND x.draw_date = dates.draw_date)""")
def upsert_import_missing(t):
    """Default amounts for each pair due on a date of the file without a row of its own."""
    daily = t.daily.withColumnRenamed("publication", "publication_id")
    defaults = daily.groupBy("account_id", "publication_id", "draw_weekday").agg(
        F.max("draw_amount").alias("draw_amount"), F.lit(0).cast("decimal(8,5)").alias("draw_rate"))
    load = daily.withColumn("delivery_date", F.col("draw_date"))
    return imports.due_but_absent(daily, load, defaults, DRAW_KEY).withColumnRenamed("publication_id", "publication")


@query("import_versions", "load load_base", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, 1 + CASE WHEN b.draw_amount % 4 = 0 THEN b.draw_amount // 4 ELSE 0 END AS version
    FROM load l JOIN load_base b USING (account_id, publication_id, draw_date) WHERE b.draw_amount <> l.draw_amount OR b.draw_rate <> l.draw_rate""")
def import_versions(t):
    """History rows numbered one above the versions already on file."""
    _, history = changes.apply_with_history(t.load_base, t.load, DRAW_KEY, VALUES, _at(), 1)
    existing = t.load_base.where("draw_amount % 4 = 0").select(*DRAW_KEY, F.expr("draw_amount div 4").alias("version"))
    return imports.history_with_version(history, existing, DRAW_KEY).select(*DRAW_KEY, "version")


@query("processing_list", "load", """
    SELECT publication_id, string_agg(DISTINCT CAST(draw_date AS VARCHAR), ', ' ORDER BY CAST(draw_date AS VARCHAR)) AS dates FROM load GROUP BY publication_id""")
def processing_list(t):
    return imports.processing_list(t.load)


@query("insert_missing", "load_base draw_lines", """
    SELECT DISTINCT account_id, publication_id FROM draw_lines d
    WHERE NOT EXISTS (SELECT 1 FROM load_base b WHERE b.account_id = d.account_id AND b.publication_id = d.publication_id)""")
def insert_missing(t):
    keys = ["account_id", "publication_id"]
    return changes.insert_missing(t.load_base.select(*keys).distinct(), t.draw_lines.select(*keys), keys)


@query("delete_join", "draws accounts", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date FROM draws WHERE account_id IN (SELECT account_id FROM accounts WHERE active = 1)""")
def delete_join(t):
    return changes.delete_keys(t.draws, t.accounts.where("active = 0"), ["account_id"]).select(*DRAW_KEY)


@query("cascade_delete", "accounts draws account_pubs default_draws assignments", """
    WITH gone AS (SELECT account_id FROM accounts WHERE active = 0)
    SELECT 'draws' AS tab, account_id, count(*) AS n FROM draws WHERE account_id NOT IN (FROM gone) GROUP BY account_id
    UNION ALL SELECT 'default_draws', account_id, count(*) FROM default_draws WHERE account_id NOT IN (FROM gone) GROUP BY account_id
    UNION ALL SELECT 'assignments', account_id, count(*) FROM assignments WHERE account_id NOT IN (FROM gone) GROUP BY account_id
    UNION ALL SELECT 'account_pubs', account_id, count(*) FROM account_pubs WHERE account_id NOT IN (FROM gone) GROUP BY account_id
    UNION ALL SELECT 'accounts', account_id, count(*) FROM accounts WHERE account_id NOT IN (FROM gone) GROUP BY account_id""")
def cascade_delete(t):
    order = ["draws", "default_draws", "assignments", "account_pubs", "accounts"]
    left = changes.cascade_delete({n: getattr(t, n) for n in order}, t.accounts.where("active = 0"), [(n, ["account_id"]) for n in order])
    return sets.stack([left[n].groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).withColumn("tab", F.lit(n)) for n in order])


@query("dedupe_keep_first", "draw_lines", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, draw_amount FROM (
        SELECT *, row_number() OVER (PARTITION BY account_id, publication_id ORDER BY draw_date, order_key, line_no, draw_amount) AS r FROM draw_lines) WHERE r = 1""")
def dedupe_keep_first(t):
    rows = t.draw_lines.select("account_id", "publication_id", "draw_date", "draw_amount",
                               F.struct("draw_date", "order_key", "line_no", "draw_amount").alias("id"))
    return changes.dedupe_keep_first(rows, ["account_id", "publication_id"], "id").drop("id")


@query("dedupe_any", "draw_lines", """
    SELECT account_id, publication_id, CASE WHEN count(*) > 1 THEN count(*) END AS copies FROM draw_lines GROUP BY account_id, publication_id""")
def dedupe_any(t):
    """One row per pair, whichever, beside the report of how many copies there were."""
    keys = ["account_id", "publication_id"]
    kept = changes.dedupe_any(t.draw_lines, keys).select(*keys)
    return kept.join(changes.duplicate_report(t.draw_lines, keys), keys, "left")


@query("dedupe_delete_latest", "subscriptions", """
    WITH dups AS (SELECT user_id, plan_id FROM subscriptions WHERE expires > DATE '1999-01-01' AND cancelled IS NULL GROUP BY 1, 2 HAVING count(*) > 1),
    doomed AS (SELECT user_id, plan_id, max(subscriber_plan_id) AS id FROM subscriptions JOIN dups USING (user_id, plan_id) GROUP BY 1, 2)
    SELECT subscriber_plan_id, s.user_id, s.plan_id FROM subscriptions s WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.id = s.subscriber_plan_id)""")
def dedupe_delete_latest(t):
    live = (F.col("expires") > F.lit("1999-01-01").cast("date")) & F.col("cancelled").isNull()
    return changes.dedupe_drop_latest(t.subscriptions, ["user_id", "plan_id"], "subscriber_plan_id", live).select(
        "subscriber_plan_id", "user_id", "plan_id")


@query("dedupe_prefer", "daily", """
    WITH d AS (SELECT *, draw_date + CASE WHEN draw_weekday = 1 THEN 1 ELSE 0 END AS delivery_date FROM daily),
    n AS (SELECT *, count(*) OVER (PARTITION BY account_id, publication, delivery_date) AS c FROM d)
    SELECT account_id, publication, CAST(draw_date AS VARCHAR) AS draw_date, CAST(delivery_date AS VARCHAR) AS delivery_date, draw_amount FROM n
    WHERE NOT (c > 1 AND draw_date = delivery_date AND draw_amount < 30)""")
def dedupe_prefer(t):
    """Sunday's and Monday's rows meet on Monday's delivery; the small Monday row goes."""
    rows = t.daily.withColumn("delivery_date", F.date_add("draw_date", F.when(F.col("draw_weekday") == 1, 1).otherwise(0)))
    return changes.dedupe_prefer(rows, ["account_id", "publication", "delivery_date"],
                                 (F.col("draw_date") == F.col("delivery_date")) & (F.col("draw_amount") < 30)).select(
        *DAILY_KEY, "delivery_date", "draw_amount")


@query("propagate_attr", "account_pubs accounts", """
    SELECT account_id, publication_id, CAST(owner_id AS BIGINT) AS ap_owner_id FROM account_pubs JOIN accounts USING (account_id)""")
def propagate_attr(t):
    """The account's owner becomes the owner of its publications."""
    owners = t.accounts.select("account_id", F.col("owner_id").cast("bigint").alias("ap_owner_id"))
    return changes.apply_updates(t.account_pubs, owners, ["account_id"], ["ap_owner_id"]).select(
        "account_id", "publication_id", "ap_owner_id")


@query("consolidate_groups", "assignments", """
    WITH several AS (SELECT template_id FROM assignments GROUP BY 1 HAVING count(DISTINCT sequence_id) > 1),
    top AS (SELECT template_id, account_id, max(sequence) AS sequence FROM assignments GROUP BY 1, 2)
    SELECT DISTINCT template_id, account_id, brand_no, top.sequence, 127 AS frequency
    FROM assignments JOIN several USING (template_id) JOIN top USING (template_id, account_id)""")
def consolidate_groups(t):
    return schedules.consolidate(t.assignments)


@query("replicate_rows", "assignments", f"""
    SELECT DISTINCT template_id, sequence_id, account_id, brand_no, frequency, sequence, replace({TEMPLATE}, 'MT', 'RT') AS mfst_code, 4 AS manifest_type_id
    FROM assignments WHERE manifest_type_id = 1""")
def replicate_rows(t):
    return schedules.replicate(t.assignments, 1, 4, "MT", "RT")


@query("restore_rows", "load load_base", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, coalesce(l.draw_amount, b.draw_amount) AS draw_amount,
           CAST(coalesce(l.draw_rate, b.draw_rate) AS DOUBLE) AS draw_rate FROM load_base b FULL JOIN load l USING (account_id, publication_id, draw_date)""")
def restore_rows(t):
    return changes.restore(t.load_base, t.load.select(*DRAW_KEY, *VALUES), DRAW_KEY, VALUES)


@query("retention_split", "draw_lines manifests", """
    SELECT 'draws' AS tab, CASE WHEN draw_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'archive' ELSE 'live' END AS part,
           CAST(draw_date AS VARCHAR) AS day, count(*) AS n FROM draw_lines GROUP BY 1, 2, 3
    UNION ALL SELECT 'manifests', CASE WHEN manifest_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'archive' ELSE 'live' END,
           CAST(manifest_date AS VARCHAR), count(*) FROM manifests GROUP BY 1, 2, 3""")
def retention_split(t):
    parts = []
    for tab, df, date in (("draws", t.draw_lines, "draw_date"), ("manifests", t.manifests, "manifest_date")):
        for part, rows in zip(("archive", "live"), changes.retention_split(df, date, "1995-01-01", "1997-12-31")):
            parts.append(rows.groupBy(F.col(date).alias("day")).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(tab).alias("tab"), F.lit(part).alias("part"), "day", "n"))
    return sets.stack(parts)


@query("category_sync", "draw_lines publications accounts", """
    WITH wanted AS (SELECT DISTINCT account_id, pub_short_name AS category FROM draw_lines JOIN publications USING (publication_id) WHERE account_id % 7 <> 0),
    own AS (SELECT account_id, 'Unknown' AS category FROM accounts UNION ALL SELECT account_id, 'Special' FROM accounts WHERE account_id % 14 = 0),
    every AS (SELECT * FROM own UNION SELECT * FROM wanted)
    SELECT account_id, category FROM every e WHERE category <> 'Unknown'
       OR NOT EXISTS (SELECT 1 FROM every x WHERE x.account_id = e.account_id AND x.category <> 'Unknown')""")
def category_sync(t):
    wanted = t.account_brands.where("account_id % 7 <> 0").select("account_id", F.col("pub_short_name").alias("category"))
    own = t.accounts.select("account_id", F.lit("Unknown").alias("category")).unionByName(
        t.accounts.where("account_id % 14 = 0").select("account_id", F.lit("Special").alias("category")))
    return accts.sync_categories(own, wanted, "Unknown")


@query("category_insert", "publications", """
    WITH own AS (SELECT DISTINCT pub_type AS category FROM publications WHERE pub_type <> 'PROMO'),
    ids AS (SELECT category, row_number() OVER (ORDER BY category) AS category_id FROM own),
    names AS (SELECT DISTINCT pub_short_name AS category FROM publications UNION SELECT DISTINCT pub_type FROM publications)
    SELECT category, (SELECT max(category_id) FROM ids) + row_number() OVER (ORDER BY category) AS category_id
    FROM names WHERE category NOT IN (SELECT category FROM own)""")
def category_insert(t):
    """A category for each publication name without one, numbered on."""
    own = t.publications.where("pub_type <> 'PROMO'").select(F.col("pub_type").alias("category")).distinct()
    ids = accts.new_categories(own.where("false").withColumn("category_id", F.lit(0)), own)
    names = t.publications.select(F.explode(F.array("pub_short_name", "pub_type")).alias("category"))
    return accts.new_categories(ids, names)


@query("random_fixture", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, draw_amount,
           CAST(('0x' || substr(md5('11|' || account_id || '|' || publication_id || '|' || CAST(draw_date AS VARCHAR)), 1, 8))::BIGINT % (draw_amount + 1) AS BIGINT) AS ret_amount
    FROM draws""")
def random_fixture(t):
    return random_returns(t.draws, DRAW_KEY, "draw_amount", 11).select(*DRAW_KEY, "draw_amount", "ret_amount")


@query("random_adjustments", "draws", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, draw_amount, CASE WHEN draw_amount = 0 THEN 0 ELSE
           CAST(('0x' || substr(md5('12|' || account_id || '|' || publication_id || '|' || CAST(draw_date AS VARCHAR)), 1, 8))::BIGINT % 10
              - ('0x' || substr(md5('12|' || account_id || '|' || publication_id || '|' || CAST(draw_date AS VARCHAR)), 9, 8))::BIGINT % 10 AS BIGINT) END AS adj_amount
    FROM draws WHERE adj_amount IS NULL""")
def random_adjustments_(t):
    """Adjustments for the draws that have none yet."""
    return random_adjustments(t.draws.drop("adj_amount"), DRAW_KEY, "draw_amount", t.draws.where("adj_amount is not null"), 12)


@query("retention_by_month", "draw_lines", """
    SELECT strftime(draw_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount FROM draw_lines
    WHERE draw_date >= DATE '1996-01-01' OR ret_amount > 0 GROUP BY 1""")
def retention_by_month(t):
    """Months before 1996 are rewritten with their returned draws only; the other months are not touched."""
    path = shared_folder(t.spark, "months")
    rows = t.draw_lines.select("account_id", "publication_id", "draw_date", "draw_amount", "ret_amount")
    tables.write_by_month(rows, path, "draw_date")
    tables.write_by_month(rows.where("draw_date < date'1996-01-01' and ret_amount > 0"), path, "draw_date", replace_only=True)
    return t.spark.read.schema("account_id bigint, publication_id bigint, draw_date date, draw_amount int, ret_amount int, month string").parquet(
        path).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"))


@query("reassign_children", "accounts draws", """
    WITH moved AS (SELECT account_id, CASE WHEN rollup_id = 3 THEN 4 ELSE rollup_id END AS rollup_id FROM accounts WHERE rollup_id IS NOT NULL)
    SELECT d.account_id, d.publication_id, CAST(d.draw_date AS VARCHAR) AS draw_date, coalesce(CAST(m.rollup_id AS BIGINT), d.rollup_id) AS rollup_id
    FROM draws d LEFT JOIN moved m USING (account_id)""")
def reassign_children(t):
    """Children of one rollup move to another, and the rollup stored on their draws follows."""
    moved = t.accounts.where("rollup_id is not null").select(
        "account_id", F.when(F.col("rollup_id") == 3, 4).otherwise(F.col("rollup_id")).cast("bigint").alias("rollup_id"))
    return changes.apply_updates(t.draws, moved, ["account_id"], ["rollup_id"]).select(*DRAW_KEY, "rollup_id")


@query("move_between_sequences", "assignments", """
    SELECT template_id, CASE WHEN sequence_id % 10 = 1 AND frequency & 1 > 0 THEN sequence_id - 1 ELSE sequence_id END AS sequence_id,
           account_id, brand_no, sequence FROM assignments""")
def move_between_sequences(t):
    """Sunday items of a template's second sequence move to its first."""
    target = F.when((F.col("sequence_id") % 10 == 1) & (F.col("frequency").bitwiseAND(1) > 0), F.col("sequence_id") - 1)
    return t.assignments.withColumn("sequence_id", F.coalesce(target, F.col("sequence_id"))).select(
        "template_id", "sequence_id", "account_id", "brand_no", "sequence")


@query("returns_file_update", "draws load", """
    SELECT d.account_id, d.publication_id, CAST(d.draw_date AS VARCHAR) AS draw_date, d.ret_amount AS old_ret_amount, l.draw_amount // 4 AS new_ret_amount
    FROM draws d JOIN load l USING (account_id, publication_id, draw_date) WHERE d.ret_amount IS DISTINCT FROM l.draw_amount // 4""")
def returns_file_update(t):
    """Old and new returns of the draws that a returns file changes."""
    file = t.load.select(*DRAW_KEY, F.expr("draw_amount div 4").alias("ret_amount"))
    return changes.changed_rows(t.draws.select(*DRAW_KEY, "ret_amount"), file, DRAW_KEY, ["ret_amount"])
