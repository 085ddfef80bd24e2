"""Manifest, sequence and account reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.plans import accounts as accts, schedules, thresholds
from pressroute.queries.q02_filters import NET
from pressroute.queries.q04_aggregates import TEMPLATE, week_sql
from pressroute.queries.registry import query
from pressroute.sources.frames import DRAW_KEY

BY_BRAND = f"""facts AS (SELECT account_id, brand_no, draw_date, draw_weekday, CAST(sum(draw_amount) AS BIGINT) AS draw_amount,
        CAST(sum({NET}) AS BIGINT) AS net FROM draw_lines JOIN publications USING (publication_id) GROUP BY 1, 2, 3, 4)"""
DAYS = "days AS (SELECT a.*, CAST(d + 1 AS INTEGER) AS weekday FROM assignments a, range(0, 7) AS r(d) WHERE frequency & (1 << d) > 0)"


@query("manifest_by_date", "draw_lines publications assignments", f"""
    SELECT template_id, CAST(draw_date AS VARCHAR) AS draw_date, count(*) AS drops, CAST(sum(draw_amount) AS BIGINT) AS draw_amount,
           CAST(sum({NET}) AS BIGINT) AS net
    FROM draw_lines f JOIN publications p USING (publication_id) JOIN assignments s ON s.account_id = f.account_id AND s.brand_no = p.brand_no AND s.frequency & (1 << (draw_weekday - 1)) > 0
    GROUP BY template_id, draw_date""")
def manifest_by_date(t):
    return schedules.net_by_manifest(t.draw_lines, t.publications, t.assignments)


@query("draw_by_manifest_day", "draw_lines publications assignments dated_manifests", f"""
    WITH {BY_BRAND}
    SELECT template_id, f.account_id, f.brand_no, CAST(draw_date AS VARCHAR) AS draw_date, draw_amount, net
    FROM facts f JOIN assignments s ON s.account_id = f.account_id AND s.brand_no = f.brand_no AND s.frequency & (1 << (draw_weekday - 1)) > 0
    UNION
    SELECT s.template_id, f.account_id, f.brand_no, CAST(f.draw_date AS VARCHAR), draw_amount, net
    FROM facts f JOIN assignments s ON s.account_id = f.account_id AND s.brand_no = f.brand_no
    JOIN dated_manifests m ON m.template_id = s.template_id AND m.manifest_date = f.draw_date""")
def draw_by_manifest_day(t):
    facts = schedules.draws_by_brand(t.draw_lines, t.publications)
    return schedules.draw_by_manifest_day(facts, t.assignments, t.dated_manifests)


@query("draw_by_dated_sequence", "draw_lines publications assignments item_history dated_manifests", f"""
    WITH {BY_BRAND}
    SELECT template_id, f.account_id, f.brand_no, CAST(draw_date AS VARCHAR) AS draw_date, draw_amount, net
    FROM facts f JOIN item_history s ON s.account_id = f.account_id AND s.brand_no = f.brand_no AND s.frequency & (1 << (draw_weekday - 1)) > 0
    WHERE valid_to IS NULL
    UNION
    SELECT s.template_id, f.account_id, f.brand_no, CAST(f.draw_date AS VARCHAR), draw_amount, net
    FROM facts f JOIN item_history s ON s.account_id = f.account_id AND s.brand_no = f.brand_no
    JOIN dated_manifests m ON m.template_id = s.template_id AND m.manifest_date = f.draw_date
    WHERE (valid_from IS NULL OR f.draw_date >= valid_from) AND (valid_to IS NULL OR f.draw_date < valid_to)""")
def draw_by_dated_sequence(t):
    """As draw_by_manifest_day, with each dated manifest's own items: those that have left since are on their old manifests."""
    facts = schedules.draws_by_brand(t.draw_lines, t.publications)
    return schedules.draw_by_dated_sequence(facts, t.item_history, t.dated_manifests)


@query("manifest_expand", "assignments dated_manifests", f"""
    WITH {DAYS}, per_day AS (SELECT template_id, weekday, count(*) AS items FROM days GROUP BY 1, 2),
    spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT p.template_id, p.weekday AS draw_weekday, items, CAST(day AS VARCHAR) AS manifest_date
    FROM per_day p JOIN spine ON extract(dow FROM day) + 1 = p.weekday
    LEFT JOIN dated_manifests m ON m.template_id = p.template_id AND m.manifest_date = day WHERE m.template_id IS NULL""")
def manifest_expand(t):
    """Manifests to add for one year."""
    return schedules.finalize(t.assignments, t.dated_manifests, "1996-01-01", "1996-12-31")


@query("sequence_by_day", "assignments", f"""
    WITH {DAYS} SELECT template_id, account_id, {week_sql("max", "sequence", "seq_", "weekday")},
           CAST(min(sequence) <> max(sequence) AS INTEGER) AS differs FROM days GROUP BY template_id, account_id""")
def sequence_by_day(t):
    return schedules.sequence_matrix(t.assignments)


@query("account_list", "accounts rollups account_types", """
    SELECT rollup_code AS acct_code, 'Rollup' AS kind, NULL AS account_type FROM rollups
    UNION ALL SELECT acct_code, 'Child', type_name FROM accounts JOIN account_types USING (account_type_id) WHERE rollup_id IS NOT NULL
    UNION ALL SELECT acct_code, 'Stand-Alone', type_name FROM accounts JOIN account_types USING (account_type_id) WHERE rollup_id IS NULL""")
def account_list(t):
    return accts.account_list(t.accounts, t.rollups, t.account_types)


@query("account_list_rollups", "children rollups", """
    SELECT rollup_code, count(child_account_id) AS children FROM rollups LEFT JOIN children USING (rollup_id) GROUP BY rollup_code""")
def account_list_rollups(t):
    return accts.rollup_children(t.accounts, t.rollups)


@query("account_dump", "accounts account_types rollups assignments default_draws publications", f"""
    SELECT account_id, acct_code, postal_code, CASE WHEN rollup_id IS NULL THEN 'Stand-Alone' ELSE 'Child Account' END AS account_kind, rollup_code,
           type_name AS category, m.manifests, pub_short_name, {", ".join(f"w.draw_{d}" for d in "sun mon tue wed thu fri sat".split())}
    FROM accounts JOIN (SELECT account_id, pub_short_name, {week_sql("max", "draw_amount", "draw_")}
                        FROM default_draws JOIN publications USING (publication_id) GROUP BY 1, 2) w USING (account_id)
    LEFT JOIN (SELECT account_id, string_agg(DISTINCT {TEMPLATE}, ', ' ORDER BY {TEMPLATE}) AS manifests FROM assignments GROUP BY 1) m USING (account_id)
    LEFT JOIN rollups USING (rollup_id) LEFT JOIN account_types USING (account_type_id) WHERE active = 1""")
def account_dump(t):
    rows = t.default_draws.select("account_id", "publication_id", "draw_weekday", F.col("draw_amount").cast("bigint").alias("draw_amount")).join(
        t.publications.select("publication_id", "pub_short_name"), "publication_id")
    return accts.account_dump(t.accounts, t.rollups, t.account_types, t.assignments, rows)


@query("unassigned", "account_pubs publications assignments", """
    WITH p AS (SELECT account_id, publication_id, brand_no FROM account_pubs JOIN publications USING (publication_id))
    SELECT 'any' AS type, account_id, publication_id FROM p WHERE NOT EXISTS (SELECT 1 FROM assignments s WHERE s.account_id = p.account_id AND s.brand_no = p.brand_no)
    UNION ALL SELECT 'delivery', account_id, publication_id FROM p WHERE NOT EXISTS (
        SELECT 1 FROM assignments s WHERE s.account_id = p.account_id AND s.brand_no = p.brand_no AND s.manifest_type_id = 1)""")
def unassigned(t):
    pairs = t.account_pubs.join(t.publications.select("publication_id", "brand_no"), "publication_id")
    def call(name, kind):
        return schedules.unassigned(pairs, t.assignments, kind).select(F.lit(name).alias("type"), "account_id", "publication_id")
    return call("any", None).unionByName(call("delivery", 1))


@query("unassigned_with_draw", "default_draws publications assignments account_pubs", """
    SELECT account_id, publication_id, active, CAST(sum(draw_amount) AS BIGINT) AS draw_amount
    FROM account_pubs JOIN publications p USING (publication_id) JOIN default_draws USING (account_id, publication_id)
    WHERE NOT EXISTS (SELECT 1 FROM assignments s WHERE s.account_id = account_pubs.account_id AND s.brand_no = p.brand_no)
    GROUP BY account_id, publication_id, active HAVING sum(draw_amount) > 0""")
def unassigned_with_draw(t):
    pairs = t.account_pubs.join(t.publications.select("publication_id", "brand_no"), "publication_id")
    sums = t.default_draws.groupBy("account_id", "publication_id").agg(F.sum("draw_amount").alias("draw_amount")).where("draw_amount > 0")
    return schedules.unassigned(pairs, t.assignments).join(sums, ["account_id", "publication_id"]).select(
        "account_id", "publication_id", "active", "draw_amount")


@query("fill_gaps", "assignments draw_lines publications", """
    WITH brands AS (SELECT DISTINCT account_id, brand_no FROM draw_lines JOIN publications USING (publication_id)),
    places AS (SELECT sequence_id, account_id, min(sequence) AS sequence FROM assignments GROUP BY 1, 2 HAVING min(sequence) = max(sequence))
    SELECT sequence_id, account_id, sequence, brand_no FROM places JOIN brands USING (account_id)
    WHERE NOT EXISTS (SELECT 1 FROM assignments a WHERE a.sequence_id = places.sequence_id AND a.account_id = places.account_id AND a.brand_no = brands.brand_no)""")
def fill_gaps(t):
    return schedules.fill_gaps(t.assignments, t.account_brands)


@query("rollup_mismatch", "draws accounts", """
    SELECT account_id, publication_id, CAST(draw_date AS VARCHAR) AS draw_date, d.rollup_id, a.rollup_id AS account_rollup
    FROM draws d JOIN accounts a USING (account_id) WHERE a.rollup_id IS NOT NULL AND coalesce(d.rollup_id, 0) <> a.rollup_id""")
def rollup_mismatch(t):
    return accts.rollup_mismatch(t.draws, t.accounts).select(*DRAW_KEY, "rollup_id", "account_rollup")


@query("ownership_audit", "assignments accounts account_pubs publications", """
    WITH ap AS (SELECT DISTINCT account_id, brand_no, ap_owner_id FROM account_pubs JOIN publications USING (publication_id)),
    s AS (SELECT DISTINCT template_id, account_id, brand_no, template_id % 25 AS template_owner FROM assignments)
    SELECT template_id, account_id, brand_no, template_owner, owner_id AS account_owner, ap_owner_id
    FROM s JOIN accounts USING (account_id) JOIN ap USING (account_id, brand_no)
    WHERE template_owner IS DISTINCT FROM owner_id OR template_owner IS DISTINCT FROM ap_owner_id""")
def ownership_audit(t):
    pairs = t.account_pubs.join(t.publications.select("publication_id", "brand_no"), "publication_id")
    return accts.owner_audit(t.assignments, t.accounts, pairs, F.col("template_id") % 25)


TYPE_RULES = "SELECT account_type_id, DATE '1999-12-26' + account_type_id AS period_start_date, 7 * account_type_id AS period_length, 3 AS cutoff_day FROM account_types WHERE account_type_id IN (1, 2)"
PUB_RULES = "SELECT publication_id, DATE '2000-01-02' AS period_start_date, 14 AS period_length, CAST(publication_id % 14 + 1 AS INTEGER) AS cutoff_day FROM publications WHERE brand_no < 10"
THRESHOLD_SQL = f"""tr AS ({TYPE_RULES}), pr AS ({PUB_RULES}),
    picked AS (SELECT y.account_type_id, p.publication_id,
        CASE WHEN tr.period_length IS NOT NULL THEN 'Acct Type' WHEN pr.period_length IS NOT NULL THEN 'Publication' ELSE 'System' END AS rule_type,
        coalesce(tr.period_start_date, pr.period_start_date, DATE '2000-01-01') AS period_start_date,
        coalesce(tr.period_length, pr.period_length, 10) AS period_length, coalesce(tr.cutoff_day, pr.cutoff_day, 4) AS cutoff_day
        FROM account_types y CROSS JOIN publications p LEFT JOIN tr USING (account_type_id) LEFT JOIN pr USING (publication_id)),
    started AS (SELECT *, period_start_date + CAST(floor((DATE '2001-06-15' - period_start_date) / period_length) AS INTEGER) * period_length AS cps FROM picked),
    cut AS (SELECT *, CASE WHEN DATE '2001-06-15' - cps + 1 >= cutoff_day THEN cps ELSE cps - period_length END AS threshold FROM started)"""


AS_OF = "2001-06-15"
SYSTEM = {"period_start_date": "2000-01-01", "period_length": 10, "cutoff_day": 4}


def _rules(t):
    kind = F.col("account_type_id")
    type_rules = t.account_types.where(kind.isin(1, 2)).select(
        "account_type_id", F.date_add(F.lit("1999-12-26").cast("date"), kind).alias("period_start_date"),
        (kind * 7).alias("period_length"), F.lit(3).alias("cutoff_day"))
    pub_rules = t.publications.where("brand_no < 10").select(
        "publication_id", F.lit("2000-01-02").cast("date").alias("period_start_date"), F.lit(14).alias("period_length"),
        (F.col("publication_id") % 14 + 1).cast("int").alias("cutoff_day"))
    return type_rules, pub_rules


@query("threshold_dates", "account_types publications", f"""
    WITH {THRESHOLD_SQL}
    SELECT account_type_id, publication_id, rule_type, CAST(period_start_date AS VARCHAR) AS period_start_date, period_length, cutoff_day,
           CAST(cps AS VARCHAR) AS current_period_start, DATE '2001-06-15' - cps AS day_in_period, CAST(cps + cutoff_day AS VARCHAR) AS cutoff_date,
           CAST(threshold AS VARCHAR) AS return_threshold FROM cut""")
def threshold_dates(t):
    return thresholds.thresholds(t.account_types, t.publications, *_rules(t), AS_OF, SYSTEM)


@query("draw_entry", "draw_lines publications accounts account_types assignments", f"""
    WITH {THRESHOLD_SQL},
    todays AS (SELECT * FROM assignments WHERE frequency & (1 << CAST(extract(dow FROM DATE '2001-06-14') AS INTEGER)) > 0),
    places AS (SELECT template_id, account_id, max(sequence) AS drop_sequence FROM todays GROUP BY 1, 2),
    items AS (SELECT DISTINCT template_id, account_id, brand_no, drop_sequence FROM todays JOIN places USING (template_id, account_id))
    SELECT i.template_id, drop_sequence, acct_code, type_name, pub_short_name, print_sort_order, d.account_id, d.publication_id,
           CAST(draw_date AS VARCHAR) AS draw_date, draw_amount, coalesce(adj_amount, 0) AS adj_amount, coalesce(adj_admin_amount, 0) AS adj_admin_amount,
           coalesce(ret_amount, 0) AS ret_amount, {NET} AS net, CASE WHEN draw_date < threshold THEN 1 ELSE 0 END AS over_threshold
    FROM draw_lines d JOIN publications p USING (publication_id) JOIN accounts a ON a.account_id = d.account_id AND a.active = 1
    JOIN account_types y ON y.account_type_id = a.account_type_id
    JOIN items i ON i.account_id = d.account_id AND i.brand_no = p.brand_no
    LEFT JOIN cut c ON c.account_type_id = a.account_type_id AND c.publication_id = d.publication_id
    WHERE draw_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-14'""")
def draw_entry(t):
    """Entry sheets of all manifests for half a year."""
    return thresholds.draw_entry(t.draw_lines, t.assignments, t.accounts, t.publications, t.account_types, *_rules(t), SYSTEM,
                                 AS_OF, "2001-06-14", "2001-01-01", "2001-06-14")


@query("rule_precedence", "account_pubs publications", """
    WITH p AS (SELECT account_id, publication_id, pub_type AS category, brand_no FROM account_pubs JOIN publications USING (publication_id))
    SELECT account_id, publication_id, category,
           CASE WHEN (account_id + publication_id) % 5 = 0 THEN 100 WHEN category = 'PROMO' THEN 200 WHEN brand_no <= 12 THEN 300 + brand_no END AS rule_id,
           CASE WHEN (account_id + publication_id) % 5 = 0 THEN 'Account Rule' WHEN category = 'PROMO' THEN 'Category Rule'
                WHEN brand_no <= 12 THEN 'Publication Rule' ELSE 'No Rule' END AS rule_type FROM p""")
def rule_precedence(t):
    pairs = t.account_pubs.join(t.publications.select("publication_id", F.col("pub_type").alias("category")), "publication_id").select(
        "account_id", "publication_id", "category")
    account_rules = t.account_pubs.where((F.col("account_id") + F.col("publication_id")) % 5 == 0).select(
        "account_id", "publication_id", F.lit(100).alias("rule_id"))
    category_rules = t.publications.where("pub_type = 'PROMO'").select(F.col("pub_type").alias("category"), F.lit(200).alias("rule_id")).distinct()
    pub_rules = t.publications.where("brand_no <= 12").select("publication_id", (F.col("brand_no") + 300).alias("rule_id"))
    return thresholds.resolve_rule(pairs, account_rules, category_rules, pub_rules)


@query("manifest_flat", "assignments", f"""
    SELECT account_id, {TEMPLATE} AS mfst_code, sequence_id, pub_short_name, frequency,
           CASE WHEN frequency & 1 > 0 THEN ' X ' ELSE ' - ' END AS sun FROM assignments""")
def manifest_flat(t):
    return schedules.assignments_flat(t.assignments).select("account_id", "mfst_code", "sequence_id", "pub_short_name", "frequency", "sun")
