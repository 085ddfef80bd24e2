"""Text functions over the log, the web pages, the documents and the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroute.functions import text as x
from pressroute.queries.registry import query


@query("str_concat", "accounts rollups", """
    SELECT account_id, acct_code || ' / ' || rollup_code AS label FROM accounts LEFT JOIN rollups USING (rollup_id)""")
def str_concat(t):
    return t.accounts.join(t.rollups, "rollup_id", "left").select(
        "account_id", x.concat("acct_code", F.lit(" / "), "rollup_code").alias("label"))


@query("str_left_right", "", "SELECT c_custkey, left(c_name, 4) AS head, right(c_name, 3) AS tail FROM customer")
def str_left_right(t):
    return t.table("customer").select("c_custkey", F.left("c_name", F.lit(4)).alias("head"), F.right("c_name", F.lit(3)).alias("tail"))


@query("str_substring", "", "SELECT c_custkey, substr(c_name, 10, 9) AS digits FROM customer")
def str_substring(t):
    return t.table("customer").select("c_custkey", F.substring("c_name", 10, 9).alias("digits"))


@query("str_charindex", "system_log", """
    SELECT log_id, instr(message, '"k"') AS first_k,
           CASE WHEN instr(substr(message, 8), 'e') > 0 THEN instr(substr(message, 8), 'e') + 7 ELSE 0 END AS later_e FROM system_log""")
def str_charindex(t):
    return t.system_log.select("log_id", x.charindex('"k"', "message").alias("first_k"), x.charindex("e", "message", 8).alias("later_e"))


@query("str_patindex", "system_log", """
    SELECT log_id, CASE WHEN regexp_matches(message, '[0-9]+') THEN length(regexp_extract(message, '^[^0-9]*')) + 1 ELSE 0 END AS first_digit
    FROM system_log""")
def str_patindex(t):
    return t.system_log.select("log_id", x.patindex("[0-9]+", "message").alias("first_digit"))


@query("str_len", "", """
    SELECT doc_id, length(rtrim(text, ' ')) AS len, strlen(text) AS bytes FROM documents""")
def str_len(t):
    return t.table("documents").select("doc_id", x.text_len("text").alias("len"), x.data_length("text").alias("bytes"))


@query("str_trim", "draws", """
    SELECT 'A' || lpad(CAST(account_id AS VARCHAR), CAST(greatest(6, length(CAST(account_id AS VARCHAR))) AS INTEGER), '0') AS code, count(*) AS n FROM (
        SELECT account_id, publication_id, draw_date FROM draw_lines WHERE line_no % 4 <> 0 GROUP BY 1, 2, 3) GROUP BY 1""")
def str_trim(t):
    return t.load_raw.groupBy(F.trim("acct_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("str_case", "publications", "SELECT publication_id, upper(pub_name) AS up, lower(pub_type) AS low FROM publications")
def str_case(t):
    return t.publications.select("publication_id", F.upper("pub_name").alias("up"), F.lower("pub_type").alias("low"))


@query("str_replace", "publications", "SELECT publication_id, replace(pub_short_name, 'Brand#', 'B-') AS code FROM publications")
def str_replace(t):
    return t.publications.select("publication_id", F.replace("pub_short_name", F.lit("Brand#"), F.lit("B-")).alias("code"))


@query("str_stuff", "", "SELECT c_custkey, left(c_name, 8) || ' no. ' || substr(c_name, 10) AS label FROM customer")
def str_stuff(t):
    return t.table("customer").select("c_custkey", x.stuff("c_name", 9, 1, " no. ").alias("label"))


@query("str_replicate", "accounts", """
    SELECT account_id, repeat('*', account_type_id + 1) AS stars, lpad(CAST(account_id AS VARCHAR), CAST(greatest(8, length(CAST(account_id AS VARCHAR))) AS INTEGER), '0') AS code FROM accounts""")
def str_replicate(t):
    return t.accounts.select("account_id", F.repeat(F.lit("*"), F.col("account_type_id") + 1).alias("stars"),
                             x.zero_pad("account_id", 8).alias("code"))


@query("str_char", "publications", "SELECT publication_id, chr(CAST(65 + brand_no AS INTEGER)) AS letter FROM publications")
def str_char(t):
    return t.publications.select("publication_id", F.chr(F.col("brand_no") + 65).alias("letter"))


@query("collapse_spaces", "", """
    SELECT doc_id, length(regexp_replace(text, ' +', ' ', 'g')) AS len, md5(regexp_replace(text, ' +', ' ', 'g')) AS fingerprint FROM documents""")
def collapse_spaces(t):
    tight = x.collapse_spaces("text")
    return t.table("documents").select("doc_id", F.length(tight).alias("len"), F.md5(tight).alias("fingerprint"))


@query("scrub_phone", "", """
    SELECT c_custkey, replace(replace(replace(replace(phone, '-', ''), '.', ''), '(', ''), ')', '') AS phone FROM (
        SELECT c_custkey, '(' || substr(c_name, 10, 3) || ') ' || substr(c_name, 13, 3) || '-' || substr(c_name, 16, 3) || '.' AS phone FROM customer)""")
def scrub_phone(t):
    n = F.col("c_name")
    raw = F.concat(F.lit("("), F.substring(n, 10, 3), F.lit(") "), F.substring(n, 13, 3), F.lit("-"), F.substring(n, 16, 3), F.lit("."))
    return t.table("customer").select("c_custkey", x.scrub_phone(raw).alias("phone"))


@query("split_delimited", "", """
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(item) AS fingerprint FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS item, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)""")
def split_delimited(t):
    return x.split_rows(t.table("documents").select("doc_id", "text"), "text", "\n").select(
        "doc_id", "pos", F.md5("item").alias("fingerprint"))


@query("nth_token", "", "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 9) AS absent FROM pages")
def nth_token(t):
    return t.table("pages").select("page_id", x.token("url", "/", 3).alias("host"), x.token("url", "/", 9).alias("absent"))


@query("extract_between", "system_log", """
    SELECT log_id, regexp_extract(message, ': (.*?)\\}', 1) AS value FROM system_log""")
def extract_between(t):
    return t.system_log.select("log_id", x.extract_between("message", ": ", "}").alias("value"))


@query("parse_query_param", "", """
    SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[^&#]') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page,
           CASE WHEN regexp_matches(url, '[?&]ref=[^&#]') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) END AS ref,
           regexp_extract(url, '^[a-z]+://[^/]*/([^/?]*)', 1) AS folder FROM pages""")
def parse_query_param(t):
    return t.table("pages").select("page_id", x.query_param("url", "page").alias("page"), x.query_param("url", "ref").alias("ref"),
                                   x.first_path_part("url").alias("folder"))


@query("parse_kv_log", "draws", """
    SELECT CAST(account_id AS VARCHAR) AS acct, CAST(publication_id AS VARCHAR) AS pub, CAST(ret_amount AS VARCHAR) AS amount,
           CAST(draw_date AS VARCHAR) AS draw_date FROM draws WHERE ret_amount > draw_amount / 20""")
def parse_kv_log(t):
    """Returns rebuilt from the error lines that rejected them."""
    line = F.format_string("Return rejected: acct=%d, pub = '%d', amount=%d; date=%s", "account_id", "publication_id", "ret_amount",
                           F.col("draw_date").cast("string"))
    log = t.draws.where("ret_amount > draw_amount / 20").select(line.alias("message"))
    return log.select(x.kv("message", "acct").alias("acct"), x.kv("message", "pub").alias("pub"),
                      x.kv("message", "amount").alias("amount"), x.kv("message", "date").alias("draw_date"))
