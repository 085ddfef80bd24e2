"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.llm.common import key_map, stage, with_key_flag
from pressroute.operators.joins import split_join

def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
                carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept`` and the ``carry`` columns.

    Texts are equal when identical; null counts as empty. The row with the largest id stays.
    Only rows whose byte length and then whose hash of the first ``prefix_chars`` characters
    occur again have their full content hashed (SHA-256). Rows to hash are found by a bitmap
    of fixed size that is broadcast: a false hit costs one hash and changes nothing, so text
    never travels through a shuffle.

    A null id is below every other one; a group of null ids only has a null ``keep_id`` and
    keeps all its rows. Rows that repeat both id and text all count in ``group_size`` and are
    all kept or all dropped. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
                       *[F.col(c).alias(f"__carry{i}") for i, c in enumerate(carry)])
    rows = rows.withColumns({"__bytes": F.octet_length("__text").cast("long"),
                             "__prefix": F.xxhash64(F.substring("__text", 1, prefix_chars))})

    profile = stage(rows.select("__bytes", "__prefix"), "dedup-profile")
    lengths = profile.groupBy("__bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same_length = split_join(profile, lengths, ["__bytes"], "left_semi")
    prefixes = same_length.groupBy("__bytes", "__prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    survivors = key_map(prefixes, ["__bytes", "__prefix"], "dedup-survivors")
    probed = with_key_flag(rows, survivors, ["__bytes", "__prefix"], "__again")
    tagged = stage(probed.select("doc_id", *[f"__carry{i}" for i in range(len(carry))], F.when(
        F.col("__again"), F.unhex(F.sha2("__text", 256))).alias("__full")), "dedup-tagged")

    hashed = tagged.where("__full is not null")
    groups = stage(hashed.groupBy("__full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                   "dedup-groups")
    alone = tagged.where("__full is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    found = split_join(hashed, groups, ["__full"]).unionByName(alone)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        *[F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry)])
