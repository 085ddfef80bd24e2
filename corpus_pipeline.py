"""A corpus pipeline over ``documents``, built from the operators: language, copies, near copies, benchmark text, tokens.

Every stage but the last returns the columns of its input and works on all rows that the stage before kept.
A document is known by ``doc_id``. Rows with a null id are judged like all others in the first stage; the later
ones cannot name them, so they stay there. Rows that repeat id and text are one document: the second stage
leaves one of them. Empty tables pass through; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressroute.llm.bpe import bpe_encode  # noqa: E402
from pressroute.llm.common import key_map, stage, train_bucket, with_key_flag  # noqa: E402
from pressroute.llm.decontaminate import contamination, is_contaminated, words_hit  # noqa: E402
from pressroute.llm.exact_dedup import exact_dedup  # noqa: E402
from pressroute.llm.language_id import UNDETERMINED, identify_language, train_language_model  # noqa: E402
from pressroute.llm.simhash import simhash_groups  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A text whose likeliest language has less of the likelihood is not told apart.
LEAST_SCORE = 0.5


def drop_ids(docs: DataFrame, gone: DataFrame, purpose: str) -> DataFrame:
    """The rows whose ``doc_id`` is not in ``gone``. Only rows that a bitmap of fixed size flags go through the join."""
    gone = stage(gone.where("doc_id is not null").select("doc_id").distinct(), purpose)
    flagged = with_key_flag(docs, key_map(gone, ["doc_id"], f"{purpose}-map"), ["doc_id"], "__flagged")
    unsure = flagged.where("__flagged").join(gone, "doc_id", "left_anti")
    return flagged.where("not __flagged").unionByName(unsure).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays open."""
    model = train_language_model(docs.where(train_bucket(F.col("doc_id")) != 0), VOCABULARY)
    told = identify_language(docs, model, keep=docs.columns, names=("__lang_pred", "__lang_score"))
    return told.where((F.col("__lang_pred") != UNDETERMINED) & (F.col("__lang_score") >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    found = stage(exact_dedup(docs), "pipeline-copies")
    left = drop_ids(docs, found.where("not kept"), "pipeline-copied")
    twice = found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    flagged = with_key_flag(left, key_map(twice, ["doc_id"], "pipeline-twice"), ["doc_id"], "__flagged")
    return flagged.where("not __flagged").unionByName(flagged.where("__flagged").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, the document with the least id stays."""
    return drop_ids(docs, simhash_groups(docs).where("doc_id != component_id"), "pipeline-near")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark windows."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drop_ids(docs, found.where(is_contaminated(words_hit(F.col("spans")), F.col("n_words"))), "pipeline-contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, ids``: the token ids as little-endian unsigned 32-bit integers."""
    encoded = bpe_encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [("language", keep_known_languages), ("exact copies", drop_exact_copies), ("near copies", drop_near_copies),
          ("decontamination", drop_contaminated), ("tokens", encode)]

#: No SQL can express the language model, the fingerprints and the encoding; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
