"""Aggregates, pivots and text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.functions.bits import DAY_CODES


def sum_if(condition: Column, value) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def csv_agg(df: DataFrame, keys: list[str], column: str, sep: str = ", ", name: str = "csv") -> DataFrame:
    """Distinct codes of a key as one text, sorted. The set is built map-side, so repeats cost nothing."""
    return df.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set(column)), sep).alias(name))


def nested_csv_agg(df: DataFrame, keys: list[str], outer: str, inner: str, name: str = "csv") -> DataFrame:
    """'A (x, y), B (z)': distinct inner codes per outer code, then outer codes per key."""
    inner_lists = csv_agg(df, [*keys, outer], inner, ", ", "__in")
    cell = F.concat(F.col(outer), F.lit(" ("), F.col("__in"), F.lit(")"))
    return inner_lists.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(cell)), ", ").alias(name))


def flatten_week(df: DataFrame, keys: list[str], weekday: str, values: dict[str, str], agg=F.max,
                 extra: tuple[Column, ...] = ()) -> DataFrame:
    """Seven columns per value. ``values`` maps a column to the prefix of its seven names;
    ``extra`` aggregates come from the same pass."""
    cells = [agg(F.when(F.col(weekday) == i + 1, F.col(col))).alias(f"{prefix}{day.lower()}")
             for col, prefix in values.items() for i, day in enumerate(DAY_CODES)]
    return df.groupBy(*keys).agg(*cells, *extra)


def unpivot_week(df: DataFrame, keys: list[str], value: str = "amount", prefix: str = "") -> DataFrame:
    """Seven weekday columns to rows with weekday 1..7; empty cells are dropped."""
    names = [f"{prefix}{d.lower()}" for d in DAY_CODES]
    rows = df.unpivot([F.col(k) for k in keys], [F.col(n) for n in names], "__day", value)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("__day")).cast("int")
    return rows.withColumn("weekday", number).drop("__day").where(F.col(value).isNotNull())


def pivot(df: DataFrame, keys: list[str], column: str, values: list, aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).agg(*aggs)


def pivot_rest(df: DataFrame, keys: list[str], column: str, values: list, measures: dict[str, str]) -> DataFrame:
    """A column per value and measure, named by the value and the measure's suffix, and ``rest``: the rows of all
    other values as text, ``value=measure/measure`` in order, null if there are none. Nothing is lost without a column."""
    cells = [F.max(F.when(F.col(column) == v, F.col(c))).alias(f"{v}{suffix}") for v in values for c, suffix in measures.items()]
    line = F.concat(F.col(column).cast("string"), F.lit("="), F.concat_ws("/", *[F.col(c).cast("string") for c in measures]))
    others = F.sort_array(F.collect_list(F.when(~F.col(column).isin(values), F.struct(F.col(column).alias("at"), line.alias("line")))))
    rest = F.nullif(F.array_join(F.transform(others, lambda x: x["line"]), ", "), F.lit(""))
    return df.groupBy(*keys).agg(*cells, rest.alias("rest"))


def pivot_long(df: DataFrame, keys: list[str], column: str, aggs: list[Column]) -> DataFrame:
    """One row per key and value in place of columns: the form for any number of values."""
    return df.groupBy(*keys, column).agg(*aggs)


def distinct_values(df: DataFrame, column: str, limit: int = 1_000) -> list:
    """Column names for a pivot, found at run time. More than ``limit`` is an error, not a cut: ``pivot_long`` has no such end."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; too many for columns")
    return sorted(r[0] for r in rows)


def pivot_dynamic(df: DataFrame, keys: list[str], column: str, aggs: list[Column], limit: int = 1_000) -> DataFrame:
    return pivot(df, keys, column, distinct_values(df, column, limit), aggs)


def length_profile(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Longest text of each column beside its allowed length. One pass over the table."""
    one = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in limits])
    allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return (one.unpivot([], [F.col(c) for c in limits], "column_name", "max_length")
            .withColumn("allowed", allowed[F.col("column_name")])
            .withColumn("too_long", F.col("max_length") > F.col("allowed")))


def percent_of(condition: Column) -> Column:
    """Share of rows that meet a condition, in percent."""
    return F.count_if(condition).cast("decimal(18,0)") / F.count(F.lit(1)).cast("decimal(18,0)") * 100
