"""Demo data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.operators.joins import split_join


def _hashed(keys: list[str], seed: int, at: int = 1) -> Column:
    """A number from a hash of seed and key: eight hexadecimal digits of it, from the given one on."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("bigint")


def random_returns(df: DataFrame, keys: list[str], measure: str, seed: int, name: str = "ret_amount") -> DataFrame:
    """Returns between zero and the draw, from a hash of seed and key.

    The same key gives the same value on any partitioning, so a task that runs again
    after a lost executor repeats itself.
    """
    return df.withColumn(name, _hashed(keys, seed) % (F.col(measure) + 1))


def random_adjustments(df: DataFrame, keys: list[str], measure: str, existing: DataFrame, seed: int, name: str = "adj_amount") -> DataFrame:
    """Adjustments to insert, between -9 and 9 and zero for a draw of zero, for the rows whose keys ``existing`` lacks.

    Run again with its own result among the ``existing`` it gives nothing: a draw has one adjustment a day.
    """
    digits = [_hashed(keys, seed, at) % 10 for at in (1, 9)]
    missing = split_join(df, existing.select(*keys).distinct(), keys, "left_anti")
    return missing.select(*keys, measure, F.when(F.col(measure) != 0, digits[0] - digits[1]).otherwise(0).alias(name))
