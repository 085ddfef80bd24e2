"""Queries by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressroute.queries.oracle_frames import compose
from pressroute.sources.frames import Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES: dict[str, str] = {}


def as_report(df: DataFrame) -> DataFrame:
    """Dates and times as text and decimals as doubles, the way the reports print them."""
    cols = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        col = F.col(f"`{field.name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            col = col.cast("string")
        elif kind == "decimal":
            col = col.cast("double")
        cols.append(col.alias(field.name))
    return df.select(*cols)


def query(name: str, frames: str = "", sql: str | None = None):
    """Register a query. ``frames`` names the canonical tables that the SQL uses."""

    def register(fn: Callable[[Frames], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_report(fn(Frames(spark, sf_dir)))

        QUERIES[name] = run
        MODULES[name] = fn.__module__
        if sql is not None:
            ORACLE[name] = compose(frames, sql)
        return fn

    return register
