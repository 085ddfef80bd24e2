"""Orders, top rows, and rows equal to an extreme."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def order_by_choice(df: DataFrame, choices: dict[int, list[str]], choice: int, default: list[str]) -> DataFrame:
    return df.orderBy(*choices.get(choice, default))


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def extreme_rows(df: DataFrame, column: str, how: str = "max") -> DataFrame:
    """Rows equal to the largest or smallest value of the whole frame; ties all stay."""
    agg = F.max if how == "max" else F.min
    return df.where(F.col(column) == df.agg(agg(column)).scalar())
