"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions.text import zero_pad
from pressroute.operators import joins, ordered
from pressroute.plans import audits, schedules
from pressroute.queries.registry import query
from pressroute.sources.frames import DAILY_KEY

TEMPLATE = "'MT' || lpad(CAST(template_id AS VARCHAR), CAST(greatest(3, length(CAST(template_id AS VARCHAR))) AS INTEGER), '0')"


@query("join_inner", "draw_lines accounts publications", """
    SELECT acct_code, pub_short_name, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount
    FROM draw_lines JOIN accounts USING (account_id) JOIN publications USING (publication_id) GROUP BY acct_code, pub_short_name""")
def join_inner(t):
    pairs = t.draw_lines.groupBy("account_id", "publication_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("draw_amount").alias("draw_amount"))
    return (pairs.join(t.publications.select("publication_id", "pub_short_name"), "publication_id")
            .join(t.accounts.select("account_id", "acct_code"), "account_id")
            .groupBy("acct_code", "pub_short_name").agg(F.sum("n").alias("n"), F.sum("draw_amount").alias("draw_amount")))


@query("join_star", "draw_lines publications assignments accounts rollups", """
    SELECT rollup_code, s.template_id, s.manifest_type_id, CAST(sum(d.draw_amount) AS BIGINT) AS draw_amount
    FROM draw_lines d JOIN publications p USING (publication_id)
    JOIN assignments s ON s.account_id = d.account_id AND s.brand_no = p.brand_no AND s.frequency & (1 << (d.draw_weekday - 1)) > 0
    JOIN accounts a ON a.account_id = d.account_id JOIN rollups r ON r.rollup_id = a.rollup_id
    GROUP BY rollup_code, s.template_id, s.manifest_type_id""")
def join_star(t):
    heads = t.accounts.select("account_id", "rollup_id").join(t.rollups.select("rollup_id", "rollup_code"), "rollup_id")
    facts = (t.draw_lines.select("account_id", "publication_id", "draw_weekday", "draw_amount")
             .join(t.publications.select("publication_id", "brand_no"), "publication_id")
             .groupBy("account_id", "brand_no", "draw_weekday").agg(F.sum("draw_amount").alias("draw_amount"))
             .join(heads, "account_id"))
    return joins.join_on_schedule(facts, t.assignments, ["account_id", "brand_no"]).groupBy(
        "rollup_code", "template_id", "manifest_type_id").agg(F.sum("draw_amount").alias("draw_amount"))


@query("join_left", "accounts rollups", """
    SELECT acct_code, rollup_code, region_id FROM accounts LEFT JOIN rollups USING (rollup_id)""")
def join_left(t):
    return t.accounts.join(t.rollups, "rollup_id", "left").select("acct_code", "rollup_code", "region_id")


@query("join_right", "children rollups", """
    SELECT rollup_code, count(child_account_id) AS children FROM children RIGHT JOIN rollups USING (rollup_id) GROUP BY rollup_code""")
def join_right(t):
    return t.children.join(t.rollups, "rollup_id", "right").groupBy("rollup_code").agg(
        F.count("child_account_id").alias("children"))


@query("join_full", "draw_lines manifests", """
    SELECT CAST(coalesce(d.day, m.day) AS VARCHAR) AS day, d.draw_lines, m.manifests
    FROM (SELECT draw_date AS day, count(*) AS draw_lines FROM draw_lines GROUP BY draw_date) d
    FULL JOIN (SELECT manifest_date AS day, count(*) AS manifests FROM manifests GROUP BY manifest_date) m ON d.day = m.day""")
def join_full(t):
    d = t.draw_lines.groupBy(F.col("draw_date").alias("day")).agg(F.count(F.lit(1)).alias("draw_lines"))
    m = t.manifests.groupBy(F.col("manifest_date").alias("day")).agg(F.count(F.lit(1)).alias("manifests"))
    return joins.full_merge(d, m, ["day"])


@query("join_anti", "account_pubs publications assignments", """
    SELECT account_id, publication_id FROM account_pubs JOIN publications USING (publication_id)
    WHERE NOT EXISTS (SELECT 1 FROM assignments s WHERE s.account_id = account_pubs.account_id AND s.brand_no = publications.brand_no)""")
def join_anti(t):
    pairs = t.account_pubs.join(t.publications.select("publication_id", "brand_no"), "publication_id")
    return joins.split_join(pairs, t.assignments.select("account_id", "brand_no").distinct(),
                            ["account_id", "brand_no"], "left_anti").select("account_id", "publication_id")


@query("join_not_in", "accounts rollups manifests", """
    SELECT 'clean list' AS list, account_id, rollup_id FROM accounts
    WHERE rollup_id NOT IN (SELECT rollup_id FROM rollups WHERE region_id < 3)
    UNION ALL
    SELECT 'list with a null', account_id, rollup_id FROM accounts WHERE rollup_id NOT IN (SELECT rollup_id FROM accounts WHERE active = 0)""")
def join_not_in(t):
    first = joins.null_aware_anti(t.accounts, t.rollups.where("region_id < 3"), "rollup_id", "rollup_id")
    second = joins.null_aware_anti(t.accounts, t.accounts.where("active = 0"), "rollup_id", "rollup_id")
    return first.select(F.lit("clean list").alias("list"), "account_id", "rollup_id").unionByName(
        second.select(F.lit("list with a null").alias("list"), "account_id", "rollup_id"))


@query("join_not_exists", "publications draw_lines assignments", """
    SELECT p.publication_id, p.pub_short_name,
           CASE WHEN EXISTS (SELECT 1 FROM draw_lines d WHERE d.publication_id = p.publication_id AND d.ret_amount > 3)
                THEN 1 ELSE 0 END AS has_returns
    FROM publications p WHERE NOT EXISTS (SELECT 1 FROM assignments s WHERE s.brand_no = p.brand_no AND s.sequence = 196)""")
def join_not_exists(t):
    free = joins.anti(t.publications, t.assignments.where("sequence = 196").select("brand_no").distinct(), ["brand_no"])
    returned = t.draw_lines.where("ret_amount > 3").select("publication_id").distinct().withColumn("has_returns", F.lit(1))
    return free.join(returned, "publication_id", "left").select(
        "publication_id", "pub_short_name", F.coalesce("has_returns", F.lit(0)).alias("has_returns"))


@query("join_cross", "publications account_types draw_lines accounts", """
    SELECT p.publication_id, y.type_name, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM publications p CROSS JOIN account_types y
    LEFT JOIN (SELECT publication_id, account_type_id, count(*) AS n FROM draw_lines JOIN accounts USING (account_id) GROUP BY 1, 2) d
      ON d.publication_id = p.publication_id AND d.account_type_id = y.account_type_id""")
def join_cross(t):
    """Every publication with every account type, drawn or not."""
    pairs = joins.pair_all(t.publications.select("publication_id"), t.account_types)
    counts = (t.draw_lines.groupBy("publication_id", "account_id").agg(F.count(F.lit(1)).alias("n"))
              .join(t.accounts.select("account_id", "account_type_id"), "account_id")
              .groupBy("publication_id", "account_type_id").agg(F.sum("n").alias("n")))
    return pairs.join(counts, ["publication_id", "account_type_id"], "left").select(
        "publication_id", "type_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_comma_range", "system_log", """
    SELECT s.log_id, CAST(s.logged_at AS VARCHAR) AS started,
           CAST((SELECT min(e.logged_at) FROM system_log e WHERE e.group_id = s.group_id AND e.message LIKE 'purchase%'
                 AND e.logged_at > s.logged_at) AS VARCHAR) AS completed
    FROM system_log s WHERE s.message LIKE 'signup%'""")
def join_comma_range(t):
    m = F.col("message")
    out = ordered.next_event_after(
        t.system_log.where(m.like("signup%")).select("group_id", "log_id", "logged_at"),
        t.system_log.where(m.like("purchase%")), ["group_id"], "logged_at", "completed")
    return out.select("log_id", F.col("logged_at").alias("started"), "completed")


@query("join_range_number", "system_log", """
    SELECT c AS letter, CAST(i AS INTEGER) AS pos, count(*) AS n
    FROM (SELECT unnest(range(1, length(message) + 1)) AS i, unnest(string_split(message, '')) AS c FROM system_log)
    GROUP BY c, i""")
def join_range_number(t):
    """Characters of each message by position: numbers up to the length, expanded per row."""
    rows = t.system_log.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("message"))))
    return rows.groupBy(F.substring("message", F.col("pos"), F.lit(1)).alias("letter"), "pos").agg(F.count(F.lit(1)).alias("n"))


def _chain(n):
    cols = ", ".join(f"CAST(d{k}.draw_amount AS BIGINT) AS draw_amount_{k}" for k in range(1, n + 1))
    sql = f"SELECT d0.account_id, d0.publication, CAST(d0.draw_date AS VARCHAR) AS draw_date, d0.draw_amount, {cols} FROM daily d0"
    for k in range(1, n + 1):
        sql += (f" LEFT JOIN daily d{k} ON d{k}.account_id = d{k-1}.account_id AND d{k}.publication = d{k-1}.publication"
                f" AND d{k}.draw_date = d{k-1}.draw_date - 7")
    return sql


@query("join_self_offset", "daily", _chain(7))
def join_self_offset(t):
    out = ordered.weekly_history(t.daily, ["account_id", "publication"], "draw_date", "draw_weekday", "draw_amount")
    return out.select(*DAILY_KEY, "draw_amount", *[f"draw_amount_{k}" for k in range(1, 8)])


@query("join_self_next_version", "audits", """
    SELECT a.account_id, a.publication, CAST(a.draw_date AS VARCHAR) AS draw_date, a.audit_id,
           CAST(a.audit_value AS INTEGER) AS amount,
           CAST(a.audit_value AS INTEGER) - coalesce(CAST(b.audit_value AS INTEGER), 0) AS diff
    FROM audits a LEFT JOIN audits b ON a.account_id = b.account_id AND a.publication = b.publication
     AND a.draw_date = b.draw_date AND b.audit_id + 1 = a.audit_id""")
def join_self_next_version(t):
    return audits.entry_amounts(t.audits, DAILY_KEY).select(*DAILY_KEY, "audit_id", "amount", "diff")


@query("join_self_overlap", "assignments", """
    WITH days AS (SELECT a.*, CAST(d AS INTEGER) AS d FROM assignments a, range(0, 7) AS r(d) WHERE frequency & (1 << d) > 0),
    crowded AS (SELECT account_id, brand_no, manifest_type_id, d, count(DISTINCT template_id) AS owners FROM days
                GROUP BY ALL HAVING count(DISTINCT template_id) > 1),
    listed AS (SELECT account_id, brand_no, manifest_type_id, template_id, sequence_id, frequency,
                      CAST(sum(1 << d) AS BIGINT) AS overlap_mask, max(owners) AS owners
               FROM days JOIN crowded USING (account_id, brand_no, manifest_type_id, d)
               GROUP BY account_id, brand_no, manifest_type_id, template_id, sequence_id, frequency)
    SELECT account_id, brand_no, t1.template_id, t1.sequence_id, t1.frequency, t1.overlap_mask, t1.owners,
           t2.template_id AS other_template_id, t2.sequence_id AS other_sequence_id, t2.frequency AS other_frequency,
           t2.overlap_mask AS other_overlap_mask, t2.owners AS other_owners, t1.frequency & t2.frequency AS shared_mask
    FROM listed t1 JOIN listed t2 USING (account_id, brand_no, manifest_type_id)
    WHERE t1.sequence_id <> t2.sequence_id AND t1.frequency & t2.frequency > 0 AND t1.template_id > t2.template_id""")
def join_self_overlap(t):
    """Each pair of overlapping assignments once, both with the days that they share with any other."""
    keys = ["account_id", "brand_no", "manifest_type_id"]
    rows = t.assignments.select(*keys, "template_id", "sequence_id", "frequency")
    listed = joins.overlapping_assignments(rows, keys, "template_id", "frequency")
    return (joins.overlapping_pairs(listed, keys, "template_id", "frequency")
            .where("sequence_id <> other_sequence_id").drop("manifest_type_id"))


@query("join_bitmask_date", "daily assignments", """
    SELECT d.account_id, d.publication, CAST(d.draw_date AS VARCHAR) AS draw_date, s.template_id, s.brand_no
    FROM daily d JOIN assignments s ON s.account_id = d.account_id AND s.frequency & (1 << (d.draw_weekday - 1)) > 0""")
def join_bitmask_date(t):
    items = t.assignments.select("account_id", "brand_no", "template_id", "frequency")
    return joins.join_on_schedule(t.daily, items, ["account_id"]).select(*DAILY_KEY, "template_id", "brand_no")


@query("join_expression_key", "load accounts", """
    SELECT acct_code, count(*) AS n, CAST(sum(draw_amount) AS BIGINT) AS draw_amount FROM load JOIN accounts USING (account_id) GROUP BY acct_code""")
def join_expression_key(t):
    """The file's code and the account's code meet in a padded form."""
    file = t.load_raw.withColumn("key", F.concat(F.lit("Supplier#"), zero_pad(F.expr("ltrim('0', substring(trim(acct_code), 2))"), 9)))
    sums = file.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("draw_amount").cast("bigint")).alias("draw_amount"))
    return sums.join(t.accounts.select("acct_code"), F.col("key") == F.col("acct_code")).select("acct_code", "n", "draw_amount")


@query("join_truncated_time", "system_log", """
    SELECT CAST(minute AS VARCHAR) AS minute, a.n AS signups, b.n AS clicks
    FROM (SELECT date_trunc('minute', logged_at) AS minute, count(*) AS n FROM system_log WHERE message LIKE 'signup%' GROUP BY 1) a
    JOIN (SELECT date_trunc('minute', logged_at) AS minute, count(*) AS n FROM system_log WHERE message LIKE 'click%' GROUP BY 1) b
    USING (minute)""")
def join_truncated_time(t):
    def per_minute(prefix, name):
        minute = F.date_trunc("minute", "logged_at").alias("at")
        return t.system_log.where(F.col("message").startswith(prefix)).groupBy(minute).agg(F.count(F.lit(1)).alias(name))
    return joins.join_minute(per_minute("signup", "signups"), per_minute("click", "clicks").withColumnRenamed("at", "at2"),
                             "at", "at2").select("minute", "signups", "clicks")


@query("join_rank_zip", "system_log", """
    WITH s AS (SELECT group_id, logged_at, row_number() OVER (PARTITION BY group_id ORDER BY logged_at, log_id) AS run
               FROM system_log WHERE message LIKE 'signup%'),
    e AS (SELECT group_id, logged_at, row_number() OVER (PARTITION BY group_id ORDER BY logged_at, log_id) AS run
               FROM system_log WHERE message LIKE 'purchase%')
    SELECT group_id, run, CAST(s.logged_at AS VARCHAR) AS started, CAST(e.logged_at AS VARCHAR) AS ended
    FROM s JOIN e USING (group_id, run)""")
def join_rank_zip(t):
    m = F.col("message")
    return ordered.pair_by_rank(t.system_log.where(m.like("signup%")), t.system_log.where(m.like("purchase%")),
                                ["group_id"], "logged_at", "log_id", ordered.ranges(t.system_log, "logged_at"))


@query("lateral_apply", "accounts assignments", f"""
    SELECT a.acct_code, string_agg(DISTINCT {TEMPLATE}, ', ' ORDER BY {TEMPLATE}) AS templates
    FROM accounts a JOIN assignments s USING (account_id) GROUP BY a.acct_code""")
def lateral_apply(t):
    """A list per account, made by a lateral subquery that Spark turns into a join."""
    a = t.accounts.select("account_id", "acct_code").alias("a")
    s = t.assignments.withColumn("code", schedules.template_code()).alias("s")
    lists = s.where(F.col("s.account_id") == F.col("a.account_id").outer()).select(
        F.array_join(F.sort_array(F.collect_set("code")), ", ").alias("templates"))
    return a.lateralJoin(lists).where("templates <> ''").select("acct_code", "templates")


@query("scalar_subquery", "draw_lines", """
    SELECT publication_id, count(*) AS n, CAST(max(draw_amount) AS BIGINT) AS top FROM draw_lines d
    WHERE draw_amount >= (SELECT avg(draw_amount) FROM draw_lines)
      AND draw_date = (SELECT max(draw_date) FROM draw_lines x WHERE x.account_id = d.account_id) GROUP BY publication_id""")
def scalar_subquery(t):
    """One value for all rows as a scalar; one value per account as a grouped join."""
    mean = t.draw_lines.agg(F.avg("draw_amount")).scalar()
    last = t.draw_lines.groupBy("account_id").agg(F.max("draw_date").alias("draw_date"))
    rows = t.draw_lines.where(F.col("draw_amount") >= mean)
    return rows.join(last, ["account_id", "draw_date"], "left_semi").groupBy("publication_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("draw_amount").cast("bigint")).alias("top"))
