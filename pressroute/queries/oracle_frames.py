"""The canonical tables in plain SQL, written apart from the Spark code, to check its results."""

from __future__ import annotations

FRAMES: dict[str, str] = {
    "draw_lines": """
        SELECT l_suppkey AS account_id, l_partkey AS publication_id, CAST(l_shipdate AS DATE) AS draw_date,
               CAST(extract(dow FROM l_shipdate) + 1 AS INTEGER) AS draw_weekday,
               CAST(l_quantity AS INTEGER) AS draw_amount,
               CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * l_discount) AS INTEGER) END AS ret_amount,
               CASE WHEN l_linestatus = 'O' THEN l_linenumber - 4 END AS adj_amount,
               CASE WHEN l_returnflag = 'A' THEN l_linenumber % 3 - 1 END AS adj_admin_amount,
               CAST(l_tax AS DECIMAL(8,5)) AS draw_rate, l_orderkey AS order_key, l_linenumber AS line_no
        FROM lineitem""",
    "draws": """
        SELECT account_id, publication_id, draw_date, draw_weekday,
               draw_date + CASE WHEN max(line_no) >= 6 THEN 1 ELSE 0 END AS delivery_date,
               CAST(sum(draw_amount) AS BIGINT) AS draw_amount, CAST(sum(ret_amount) AS BIGINT) AS ret_amount,
               CAST(sum(adj_amount) AS BIGINT) AS adj_amount, CAST(sum(adj_admin_amount) AS BIGINT) AS adj_admin_amount,
               max(draw_rate) AS draw_rate,
               CAST(sum(CASE WHEN line_no % 3 <> 0 THEN ret_amount END) AS BIGINT) AS ret_export_last,
               CAST(sum(CASE WHEN line_no % 2 = 0 THEN adj_amount END) AS BIGINT) AS adj_export_last,
               max(order_key % 25) AS rollup_id, max(line_no % 3) AS last_change_type
        FROM draw_lines GROUP BY account_id, publication_id, draw_date, draw_weekday""",
    "default_draws": """
        SELECT account_id, publication_id, draw_weekday, max(draw_amount) AS draw_amount, max(draw_rate) AS draw_rate,
               max(line_no % 2) AS allow_forecasting, min(line_no % 2) AS allow_returns,
               min(line_no % 3) AS allow_adjustments, min(draw_amount) AS forecast_min, max(draw_amount) AS forecast_max
        FROM draw_lines GROUP BY account_id, publication_id, draw_weekday""",
    "daily": """
        SELECT user_id AS account_id, event_type AS publication, CAST(ts AS DATE) AS draw_date,
               CAST(extract(dow FROM ts) + 1 AS INTEGER) AS draw_weekday,
               CAST(sum(floor(value)) AS BIGINT) AS draw_amount,
               CAST(sum(CASE WHEN event_id % 4 = 0 THEN floor(value / 2) END) AS BIGINT) AS ret_amount,
               CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 END) AS BIGINT) AS adj_amount,
               CAST(sum(CASE WHEN event_id % 7 = 0 THEN -1 END) AS BIGINT) AS adj_admin_amount
        FROM events GROUP BY user_id, event_type, CAST(ts AS DATE), extract(dow FROM ts)""",
    "draw_exports": """
        SELECT user_id AS account_id, event_type AS publication, CAST(ts AS DATE) AS draw_date,
               max(CASE WHEN event_id % 4 = 0 THEN ts + to_hours(event_id % 40) END) AS ret_exported_at,
               max(CASE WHEN event_id % 5 = 0 THEN ts + to_hours(event_id % 40) + INTERVAL 1 DAY END) AS adj_exported_at
        FROM events GROUP BY ALL""",
    "audits": """
        SELECT user_id AS account_id, event_type AS publication, CAST(ts AS DATE) AS draw_date, ts AS audit_time,
               event_id, event_id % 6 AS audit_user_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS audit_value,
               row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS audit_id
        FROM events WHERE event_type IN ('click', 'purchase')""",
    "history": """
        SELECT event_id AS history_id, user_id AS account_id, event_type AS publication, CAST(ts AS DATE) AS draw_date,
               date_trunc('hour', ts) AS changed_at, CAST(floor(value) AS BIGINT) AS old_draw,
               CAST(floor(value) AS BIGINT) + event_id % 5 - 2 AS new_draw, event_id % 4 AS change_type_id
        FROM events""",
    "accounts": """
        SELECT s_suppkey AS account_id, s_name AS acct_code, s_nationkey AS owner_id,
               CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS rollup_id,
               CAST(s_suppkey % 4 AS INTEGER) AS account_type_id,
               lpad(CAST(s_nationkey * 397 AS VARCHAR), CAST(greatest(5, length(CAST(s_nationkey * 397 AS VARCHAR))) AS INTEGER), '0') AS postal_code,
               CAST(s_acctbal >= 1000 AS INTEGER) AS active, CAST(s_suppkey % 3 = 0 AS INTEGER) AS imported
        FROM supplier""",
    "rollups": "SELECT n_nationkey AS rollup_id, n_name AS rollup_code, n_regionkey AS region_id FROM nation",
    "children": "SELECT rollup_id, account_id AS child_account_id FROM accounts WHERE rollup_id IS NOT NULL",
    "account_types": """SELECT * FROM (VALUES (0, 'Dealer'), (1, 'Rack'), (2, 'Hotel'), (3, 'School'))
        AS v(account_type_id, type_name)""",
    "publications": """
        SELECT p_partkey AS publication_id, p_brand AS pub_short_name, p_name AS pub_name, p_type AS pub_type,
               p_size AS print_sort_order, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no
        FROM part""",
    "account_pubs": """
        SELECT DISTINCT account_id, publication_id,
               CASE WHEN (account_id + publication_id) % 11 <> 0 THEN 1 ELSE 0 END AS active,
               publication_id % 25 AS ap_owner_id
        FROM draw_lines""",
    "assignments": """
        SELECT s_suppkey AS account_id, CAST(b AS INTEGER) AS brand_no, 'Brand#' || b AS pub_short_name,
               CAST((s_suppkey * 3 + b % 2 + k * 17) % 40 + 1 AS INTEGER) AS template_id,
               CAST(((s_suppkey * 3 + b % 2 + k * 17) % 40 + 1) * 10 + k AS INTEGER) AS sequence_id,
               CASE (s_suppkey + b) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS manifest_type_id,
               CAST(1 + (s_suppkey * 7 + b + k * 31) % 127 AS INTEGER) AS frequency,
               CAST((s_suppkey * 13 + ((s_suppkey * 3 + b % 2 + k * 17) % 40 + 1) * 7) % 200
                    + CASE WHEN b % 12 = 0 THEN 1 ELSE 0 END AS INTEGER) AS sequence
        FROM supplier, range(1, 26) AS brands(b), range(0, 2) AS slots(k)
        WHERE (s_suppkey + b + k) % 5 <> 0 AND (s_suppkey * 3 + b) % 10 <> 0""",
    "item_history": """
        SELECT template_id, account_id, brand_no, frequency, CASE WHEN (account_id + brand_no) % 7 = 0 THEN DATE '1996-01-01' END AS valid_from,
               CAST(NULL AS DATE) AS valid_to FROM assignments
        UNION ALL SELECT CAST((s_suppkey * 3 + b % 2 + k * 17) % 40 + 1 AS INTEGER), s_suppkey, CAST(b AS INTEGER),
               CAST(1 + (s_suppkey * 7 + b + k * 31) % 127 AS INTEGER), NULL, DATE '1997-01-01'
        FROM supplier, range(1, 26) AS brands(b), range(0, 2) AS slots(k)
        WHERE (s_suppkey + b + k) % 5 = 0 AND (s_suppkey * 3 + b) % 10 <> 0""",
    "manifests": """
        SELECT o_orderkey AS manifest_id, CAST(o_orderdate AS DATE) AS manifest_date, o_orderpriority AS mfst_code,
               o_custkey AS owner_id,
               CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 4 END AS manifest_type_id
        FROM orders""",
    "dated_manifests": """
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS manifest_date,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS template_id,
               CAST(extract(dow FROM o_orderdate) + 1 AS INTEGER) AS draw_weekday
        FROM orders""",
    "system_log": """
        SELECT ts AS logged_at, event_type || ' ' || props AS message, user_id AS group_id, event_id AS log_id
        FROM events""",
    "transfers_a": """
        SELECT *, CASE WHEN event_id % 11 <> 0 THEN ts END AS dl_start, CAST(floor(value) AS BIGINT) AS secs FROM events""",
    "transfers_b": """
        SELECT *, CASE WHEN event_id % 7 <> 0 THEN dl_start + to_seconds(secs) END AS dl_end FROM transfers_a""",
    "transfers_c": """
        SELECT *, CASE WHEN event_id % 4 <> 0 THEN dl_end + to_seconds(event_id % 30 * 3600) END AS ul_start
        FROM transfers_b""",
    "transfers": """
        SELECT event_id AS transfer_id, user_id AS device_id, CAST(ts AS DATE) AS mfst_date, event_type AS mfst_code,
               event_id % 40 + 1 AS drops, dl_start, dl_end, ul_start,
               CASE WHEN event_id % 9 <> 0 THEN ul_start + to_seconds(secs * 2) END AS ul_end
        FROM transfers_c""",
    "subscriptions": """
        SELECT o_orderkey AS subscriber_plan_id, o_custkey AS user_id, o_orderkey % 6 AS plan_id,
               CAST(o_orderdate AS DATE) AS purchase_date, CAST(o_orderdate AS DATE) + 365 AS expires,
               CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS cancelled
        FROM orders""",
    "weblog": """
        SELECT ts AS logged_at,
               '/c' || (user_id % 3) || CASE WHEN event_type = 'signup' THEN '/ack' ELSE '/drop' END AS page,
               'mfstid=' || user_id || '&dropid=' || (event_id % 20) AS query
        FROM events""",
    "load": """
        SELECT account_id, publication_id, draw_date, draw_date AS delivery_date,
               CAST(extract(dow FROM draw_date) + 1 AS INTEGER) AS draw_weekday,
               CAST(sum(draw_amount + CASE WHEN order_key % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS draw_amount,
               max(draw_rate) AS draw_rate
        FROM draw_lines WHERE line_no % 4 <> 0 GROUP BY account_id, publication_id, draw_date""",
    "load_base": """
        SELECT account_id, publication_id, draw_date, CAST(sum(draw_amount) AS BIGINT) AS draw_amount,
               max(draw_rate) AS draw_rate
        FROM draw_lines WHERE line_no % 5 <> 0 GROUP BY account_id, publication_id, draw_date""",
}

NEEDS = {
    "draws": ["draw_lines"], "default_draws": ["draw_lines"], "account_pubs": ["draw_lines"],
    "children": ["accounts"], "item_history": ["assignments"], "load": ["draw_lines"], "load_base": ["draw_lines"],
    "transfers_b": ["transfers_a"], "transfers_c": ["transfers_b"], "transfers": ["transfers_c"],
}


def compose(frames: str, body: str) -> str:
    """The body with the tables it names in front, each after the ones it is made from."""
    names: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in names:
            names.append(name)

    for frame in frames.split():
        add(frame)
    body = body.strip()
    if not names:
        return body
    prelude = "WITH " + ",\n".join(f"{n} AS ({FRAMES[n].strip()})" for n in names)
    if body.upper().startswith("WITH "):
        return f"{prelude},\n{body[5:]}"
    return f"{prelude}\n{body}"
