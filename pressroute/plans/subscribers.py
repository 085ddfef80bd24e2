"""Subscribers, plans and billing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.operators.joins import split_join
from pressroute.operators.sorting import extreme_rows


def active_subs(plans: DataFrame, keys: DataFrame, begin: str, end: str, excluded: list[int]) -> DataFrame:
    """Plans that active subscribers purchased in a closed range of dates, excluded plans left out, one row each.

    A subscriber is active with an active plan that expires after the end. One who purchased a plan of their own
    (not a linked one) and has an inactive plan is confirmed: the purchase was recorded and mapped back to a linked
    plan, so their inactive plans are listed, and only those. ``fields`` holds the key fields as ``name=value``
    in order of name, as many as there are.
    """
    lo, hi = F.lit(begin).cast("date"), F.lit(end).cast("date")
    listed = ~F.col("plan_id").isin(excluded)
    users = plans.groupBy("user_id").agg(
        F.max(F.col("active") & (F.col("expires") > hi)).alias("__live"),
        (F.max(listed & ~F.col("linked")) & F.max(~F.col("active"))).alias("__confirmed")).where("__live")
    bought = plans.where(F.col("purchase_date").between(lo, hi) & listed)
    rows = split_join(bought, users, ["user_id"]).where(~F.col("__confirmed") | ~F.col("active")).drop("__live", "__confirmed")
    line = F.concat(F.col("field"), F.lit("="), F.col("value"))
    lists = keys.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("fields"))
    return split_join(rows, lists, ["user_id"], "left")


def next_period(periods: DataFrame, days: int = 7) -> DataFrame:
    """The last billing period moved on by its length."""
    last = extreme_rows(periods, "period_id")
    return last.select((F.col("period_id") + 1).alias("period_id"),
                       *[F.date_add(c, days).alias(c) for c in ("begin_date", "end_date", "cutoff_date")],
                       F.lit(0).alias("status"))
