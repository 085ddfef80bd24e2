"""Delimited, fixed-layout and web-log files; exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "\t", header: bool = True) -> DataFrame:
    """Rows that do not fit the schema stay, with their text in ``bad_row``."""
    full = StructType([*schema.fields, StructField("bad_row", StringType())])
    return (spark.read.schema(full).option("sep", sep).option("header", header)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_row").csv(path))


def read_fixed(spark: SparkSession, path: str, layout: list[tuple[str, int, int]]) -> DataFrame:
    """Fixed column layout: (name, 1-based start, length). Values come trimmed, empty as null."""
    return spark.read.text(path).select(*[
        F.nullif(F.trim(F.substring("value", start, length)), F.lit("")).alias(name)
        for name, start, length in layout])


def write_fixed(df: DataFrame, path: str, layout: list[tuple[str, int, int]]) -> None:
    """Values padded to their field. One that is wider than its field fails the job and names the column."""
    def cell(name: str, length: int):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        wide = F.raise_error(F.concat(F.lit(f"{name}: a value is wider than its {length} characters: "), text)).cast("string")
        return F.when(F.length(text) > length, wide).otherwise(F.rpad(text, length, " "))

    cells = [cell(name, length) for name, _, length in layout]
    df.select(F.concat(*cells).alias("value")).write.text(path)


def read_weblog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Space-delimited web log; lines that start with # are headers. A dash is a missing value."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", " ")
    return lines.select(*[F.nullif(F.get(parts, F.lit(i)), F.lit("-")).alias(c) for i, c in enumerate(columns)])


def export_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = True) -> None:
    df.write.option("sep", sep).option("header", header).csv(path)


def export_partitioned(df: DataFrame, key: str, path: str, rows_per_file: int = 5_000_000) -> None:
    """One folder per key value.

    The rebalance hint shuffles by key, and adaptive execution splits a key that is larger
    than one partition, so a hot key is written by many tasks in files of bounded size.
    """
    (df.hint("rebalance", key).write.partitionBy(key)
     .option("maxRecordsPerFile", rows_per_file).option("header", True).csv(path))
