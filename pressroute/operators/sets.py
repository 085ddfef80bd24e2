"""Stacking, set difference and table comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.session import shared_folder
from pressroute.sources.tables import staged


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def minus(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def intersect_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_semi")


def diff_tables(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full compare: left only, right only, changed or same, both values side by side."""
    l = left.select(*keys, F.lit(True).alias("__l"), *[F.col(v).alias(f"left_{v}") for v in values])
    r = right.select(*keys, F.lit(True).alias("__r"), *[F.col(v).alias(f"right_{v}") for v in values])
    same = reduce(Column.__and__, [F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}")) for v in values])
    status = (F.when(F.col("__r").isNull(), "left only").when(F.col("__l").isNull(), "right only")
              .when(same, "same").otherwise("changed"))
    return l.join(r, keys, "full").withColumn("status", status).drop("__l", "__r")


def bucket_sums(df: DataFrame, keys: list[str], values: list[str], month: str | None, buckets: int) -> DataFrame:
    """``month, bucket, rows, checks``: per month and hash bucket of the keys, how many rows there are and two sums of
    their hashes that do not depend on the rows' order. One scan, combined in the tasks; months times buckets rows."""
    each = F.xxhash64(*keys, *values)
    return df.groupBy((F.col(month) if month else F.lit("")).alias("month"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.struct(F.bit_xor(each).alias("x"), F.sum(each.cast("decimal(38,0)")).alias("s")).alias("checks"))


def differing_rows(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], month: str | None = None,
                   buckets: int = 64) -> DataFrame:
    """``diff_tables`` without the rows that are the same, reading for the join only where the tables differ.

    Both tables are first folded to row counts and checksums by month and hash bucket. Only buckets whose sums differ
    are joined; for tables in month folders (``write_by_month``; name the folder's column) the months before the
    first and after the last difference are not read again, and of equal tables nothing is. Rows that differ and
    have equal 64-bit hashes in two sums at once would be passed over.
    """
    sums = [bucket_sums(df, keys, values, month, buckets) for df in (left, right)]
    other = sums[1].select("month", "bucket", F.col("rows").alias("__rows"), F.col("checks").alias("__checks"))
    unequal = staged(sums[0].join(other, ["month", "bucket"], "full").where(
        ~(F.col("rows").eqNullSafe(F.col("__rows")) & F.col("checks").eqNullSafe(F.col("__checks")))).select("month", "bucket"),
        shared_folder(left.sparkSession, "unequal"))

    def part(df: DataFrame) -> DataFrame:
        rows = df.withColumn("__month", F.col(month) if month else F.lit("")).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        if month:
            rows = rows.where(F.col(month).between(unequal.agg(F.min("month")).scalar(), unequal.agg(F.max("month")).scalar()))
        picked = unequal.select(F.col("month").alias("__month"), F.col("bucket").alias("__bucket"))
        return rows.join(picked, ["__month", "__bucket"], "left_semi")

    return diff_tables(part(left), part(right), keys, values).where("status <> 'same'")
