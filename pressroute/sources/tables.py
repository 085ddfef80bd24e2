"""Named tables, several catalogues, snapshots and appends."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, name: str, base: str | None = None) -> DataFrame:
    """A catalogue table, or a parquet table under another base path."""
    return spark.table(name) if base is None else spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def union_over(companies: dict[str, str], query: Callable[[str], DataFrame]) -> DataFrame:
    """One query per company base, stacked, with the company as a column."""
    return reduce(DataFrame.unionByName, [
        query(base).withColumn("company", F.lit(company)) for company, base in companies.items()])


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a relation inside the plan: no Python worker, size known to the optimizer."""
    fields = [f.split() for f in schema.split(",")]
    cells = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*cells)))


def write_snapshot(df: DataFrame, base: str, taken: str) -> str:
    """Copy of a table under ``snapshot=yyyyMMddHHmmss``."""
    path = f"{base}/snapshot={taken}"
    df.write.parquet(path)
    return path


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def snapshots(spark: SparkSession, base: str) -> DataFrame:
    """All snapshots as one table; the time of each comes from its folder name."""
    df = spark.read.option("basePath", base).parquet(f"{base}/snapshot=*")
    return df.withColumn("snapshot_taken", F.to_timestamp(F.col("snapshot").cast("string"), "yyyyMMddHHmmss")
                         .cast("timestamp_ntz")).drop("snapshot")


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """A catalogue table bucketed and sorted by its keys: later joins and aggregates on them need no shuffle.

    For facts that many reports join on the same keys. Pick buckets so that one fits in
    executor memory; a hot key still fills one bucket, so do not bucket by a skewed key alone.
    """
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table))


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write a result once and go on from the files: cuts the lineage, and several outputs share the work."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_month(df: DataFrame, path: str, date: str, replace_only: bool = False) -> None:
    """Facts in one folder per month, so that date filters skip folders and retention works month by month.

    With ``replace_only`` just the months present in ``df`` are replaced; all others stay. The
    rebalance hint lets adaptive execution split a month that is larger than one partition.
    """
    rows = df.withColumn("month", F.date_format(date, "yyyy-MM"))
    mode = "dynamic" if replace_only else "static"
    (rows.hint("rebalance", "month").write.partitionBy("month").mode("overwrite")
     .option("partitionOverwriteMode", mode).parquet(path))
