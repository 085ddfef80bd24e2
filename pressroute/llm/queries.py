"""Registered queries of the operators: thin digests over their real outputs, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressroute.llm.ball_tree_search import search
from pressroute.llm.bpe import bpe_decode, bpe_encode
from pressroute.llm.common import train_bucket
from pressroute.llm.conversation_repair import damage, plan_repairs, repair_report
from pressroute.llm.decontaminate import contamination, is_contaminated, words_hit
from pressroute.llm.exact_dedup import exact_dedup
from pressroute.llm.html_crf import extract_main_text, labelled_pages, train_extractor
from pressroute.llm.language_id import identify_language, train_language_model
from pressroute.llm.license_scan import scan_licenses
from pressroute.llm.lm_scoring import score_documents
from pressroute.llm.minhash import minhash_groups
from pressroute.llm.sharding import shard_documents
from pressroute.llm.simhash import simhash_groups
from pressroute.llm.suffix_dedup import repeated_passages

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_html_crf")
def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"), train_extractor(labelled_pages()), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").withColumn("held_out", train_bucket(F.col("doc_id")) == 0)
    model = train_language_model(docs.where("not held_out"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return identify_language(docs, model, keep=["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


@register("op4_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return exact_dedup(docs, carry=["text_sha256"])


@register("op6_bpe_prefix_dp")
def op6_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                             F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = bpe_decode(digests, path, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op7_simhash_pivots")
def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ALNUM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op9_positional_decontamination", f"""
    WITH d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
    i AS (SELECT item_id, {ALNUM_SQL} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS win
                FROM i, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(s) WHERE len(w) > 0),
    places AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
               FROM d, (SELECT DISTINCT n FROM windows), unnest(generate_series(1, len(w) - n + 1)) AS t(s)),
    met AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, win)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(generate_series(s, s + n - 1)) AS t(p) GROUP BY doc_id),
    owners AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
               FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)""")
def op9_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_hit", words_hit(F.col("spans"))).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@register("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base_places", lambda p: p["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), F.concat_ws(",", "base_labels").alias("base_labels"),
                        F.concat_ws(",", "labels").alias("labels"), "score")


@register("op2_balanced_sharding")
def op2_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op10_bloom_lm")
def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", train_bucket(F.col("doc_id")) == 1)
    return score_documents(docs, docs.where("not held_out"), keep=["held_out"])


@register("op5_sparse_suffix_dedup")
def op5_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("first_word").cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"), "other_doc_id")


@register("op11_ball_tree_search", f"""
    WITH d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
    totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
    i AS (SELECT item_id, unnest(list_distinct({ALNUM_SQL})) AS term FROM benchmark),
    tf AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, term, count(*) AS tf
           FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                FROM tf, totals GROUP BY term),
    scores AS (SELECT item_id, doc_id, CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
               FROM i JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 10""")
def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damage(conversations)
    return repair_report(conversations, rows, plan_repairs(rows))


@register("op13_minhash_bbit", r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                              ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS g FROM d),
    x AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (shingle) WHERE a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
    SELECT doc_id, CAST(len(any_value(g)) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
    FROM s JOIN reach USING (doc_id) GROUP BY doc_id""")
def op13_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))
