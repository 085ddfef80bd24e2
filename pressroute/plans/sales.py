"""Sales reports over dated draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.functions.values import net_sales, ratio_percent, zero
from pressroute.operators.joins import anti, pair_with_dates, split_join
from pressroute.operators.ordered import latest_with_ties, weekly_history


def with_net(draws: DataFrame) -> DataFrame:
    return draws.withColumn("net", net_sales())


def sales_history(draws: DataFrame, keys: list[str], date=None, weeks: int = 7) -> DataFrame:
    """Net of the same weekday 1 .. n weeks back, wide and as text, for one date or for all.

    With a date only the rows of the last n weeks are read.
    """
    if date is not None:
        draws = draws.where(F.col("draw_date").between(
            F.date_sub(F.lit(date).cast("date"), 7 * weeks), F.lit(date).cast("date")))
    wide = weekly_history(with_net(draws), keys, "draw_date", "draw_weekday", "net", weeks)
    wide = wide.withColumn("net_text", F.concat_ws(", ", *[F.col(f"net_{k}") for k in range(1, weeks + 1)]))
    return wide if date is None else wide.where(F.col("draw_date") == F.lit(date).cast("date"))


def history_with_last_change(sales: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sales history beside the latest change of each draw. A draw without a change drops out; ties stay."""
    last = latest_with_ties(changes, keys, "changed_at").select(*keys, "changed_at", "old_draw", "new_draw", "change_type_id")
    return sales.join(last, keys)


def weekly_net(draws: DataFrame, accounts: DataFrame, publications: DataFrame, week_start: Column) -> DataFrame:
    """Net per postal code, publication and week in seven columns, column i being i days after the start.

    One aggregate after the two dimension joins: its combine runs in the join's own tasks,
    and each row lands in one of seven sums.
    """
    rows = (with_net(draws).select("account_id", "publication_id", "draw_date", "net").join(accounts.select("account_id", "postal_code"), "account_id")
            .join(publications.select("publication_id", "pub_short_name"), "publication_id")
            .withColumn("week_start", week_start))
    day = F.datediff("draw_date", "week_start")
    return rows.groupBy("postal_code", "pub_short_name", "week_start").agg(*[
        F.sum(F.when(day == i, F.col("net"))).alias(f"net{i}") for i in range(7)])


def week_over_week(draws: DataFrame, keys: list[str], measure: str = "draw_amount") -> DataFrame:
    wide = weekly_history(draws, keys, "draw_date", "draw_weekday", measure, 2)
    return wide.select(*keys, "draw_date", measure, f"{measure}_1", f"{measure}_2",
                       (F.col(measure) - F.col(f"{measure}_1")).alias("change"))


def pct_change(draws: DataFrame, keys: list[str], days: int = 7) -> DataFrame:
    """Old over new in percent, for rows that rose against the row ``days`` earlier."""
    before = draws.select(*keys, F.date_add("draw_date", days).alias("draw_date"), F.col("draw_amount").alias("old_draw"))
    both = draws.select(*keys, "draw_date", F.col("draw_amount").alias("new_draw")).join(before, [*keys, "draw_date"])
    return both.where("new_draw > old_draw").withColumn("pct", ratio_percent("old_draw", "new_draw"))


def rollup_totals(changes: DataFrame, accounts: DataFrame, rollups: DataFrame) -> DataFrame:
    """Changed draws of child accounts beside the totals of their rollup."""
    rows = (changes.where("old_draw <> new_draw").join(accounts.select("account_id", "acct_code", "rollup_id"), "account_id")
            .join(rollups.select("rollup_id", "rollup_code"), "rollup_id"))
    keys = ["rollup_code", "publication", "draw_date"]
    totals = rows.groupBy(*keys).agg(F.sum("old_draw").alias("rollup_old"), F.sum("new_draw").alias("rollup_new"))
    return split_join(rows, totals, keys)


def zero_draw_months(draws: DataFrame, keys: list[str], as_of: str, months: int = 12) -> DataFrame:
    """Longest trailing window of whole months (at most 12) that has rows and sums to zero.

    One pass: a conditional sum and count per window length, instead of one query per month.
    """
    date = F.lit(as_of).cast("date")
    tests = []
    for m in range(1, months + 1):
        inside = F.col("draw_date") > F.add_months(date, -m)
        tests.append(F.when((F.count_if(inside) > 0) & (F.sum(F.when(inside, F.col("draw_amount"))) == 0), m))
    return (draws.groupBy(*keys).agg(F.greatest(*tests).alias("months_with_zero"))
            .where("months_with_zero is not null"))


def stale(draws: DataFrame, keys: list[str], as_of: str, days: int) -> DataFrame:
    """Keys whose last positive draw is more than ``days`` back."""
    last = draws.where("draw_amount > 0").groupBy(*keys).agg(F.max("draw_date").alias("last_nonzero"))
    return last.where(F.col("last_nonzero") < F.date_sub(F.lit(as_of).cast("date"), days))


def export_delta(draws: DataFrame) -> DataFrame:
    """Rows whose returns or adjustments differ from what was last exported."""
    adj = zero("adj_amount") + zero("adj_admin_amount")
    return (draws.withColumn("adj_total", adj)
            .withColumn("returns_due", (zero("ret_amount") != zero("ret_export_last")).cast("int"))
            .withColumn("adjustments_due", (adj != zero("adj_export_last")).cast("int"))
            .where("returns_due = 1 or adjustments_due = 1"))


def export_rollback(draws: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Set the last exported returns to the current returns for the rows of an archived export file."""
    hit = archive.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return (split_join(draws, hit, keys, "left")
            .withColumn("ret_export_last", F.when(F.col("__hit"), F.col("ret_amount")).otherwise(F.col("ret_export_last")))
            .drop("__hit"))


def densify(facts: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Zero rows for each key and date of a range without one. The dates expand in place."""
    wanted = pair_with_dates(facts.select(*keys).distinct(), start, stop, "draw_date")
    return anti(wanted, facts, [*keys, "draw_date"]).select(
        *keys, "draw_date", F.dayofweek("draw_date").alias("draw_weekday"), F.lit(0).alias("draw_amount"))


def pull_forward(facts: DataFrame, keys: list[str], days: int = 7) -> DataFrame:
    """Rows shifted ``days`` ahead, each an update where the target date exists and an insert where it does not."""
    source = facts.select(*keys, F.date_add("draw_date", days).alias("draw_date"), F.col("draw_amount").alias("source_draw"))
    target = facts.select(*keys, "draw_date", F.col("draw_amount").alias("old_draw"))
    return source.join(target, [*keys, "draw_date"], "left").withColumn(
        "action", F.when(F.col("old_draw").isNull(), "insert").otherwise("update"))

