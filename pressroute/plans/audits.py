"""Returns and adjustments audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.functions.values import net_sales, zero
from pressroute.operators.joins import split_join
from pressroute.operators.ordered import first_last, latest, next_version, version_diff


def with_amount(audits: DataFrame) -> DataFrame:
    return audits.withColumn("amount", F.col("audit_value").cast("int"))


def entry_amounts(audits: DataFrame, keys: list[str]) -> DataFrame:
    """What each entry added: its value less the value of the entry before."""
    return version_diff(with_amount(audits), keys, "audit_id", "amount")


def returns_audit(audits: DataFrame, draws: DataFrame, keys: list[str], negative_net_only: bool = False) -> DataFrame:
    """All entries of each draw that has more than one, in one row: ``entry`` is an array of user, value, difference to
    the entry before and time, in order. One shuffle; an array holds as many entries as a draw has."""
    one = F.struct(F.col("audit_id"), F.col("audit_user_id").alias("user"), F.col("amount").alias("value"), F.col("audit_time").alias("time"))
    lists = with_amount(audits).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("e")).where(F.size("e") > 1)
    entries = F.transform("e", lambda x, i: F.struct(
        x["user"].alias("user"), x["value"].alias("value"),
        (x["value"] - F.coalesce(F.get(F.col("e"), i - 1)["value"], F.lit(0))).alias("difference"), x["time"].alias("time")))
    out = lists.select(*keys, F.size("e").alias("entries"), entries.alias("entry")).join(draws.select(*keys, "draw_amount", "net"), keys)
    return out.where("net < 0") if negative_net_only else out


#: Entries of one draw that ``entry_columns`` lays out; each takes four columns.
MOST_ENTRIES = 250


def entry_columns(report: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """``returns_audit`` with columns user1, value1, difference1, time1, user2 ..: as many as the longest list has.

    A draw with more than ``most_entries`` is an error before anything is laid out: a plan of tens of thousands of columns
    does not end. The report itself, with its entries as a list, has no such bound.
    """
    most = report.agg(F.max("entries")).first()[0] or 0
    if most > most_entries:
        raise ValueError(f"a draw has {most} entries, more than {most_entries}: use the list 'entry' of returns_audit, or explode it")
    return report.select("*", *[F.get("entry", F.lit(v - 1))[name].alias(f"{name}{v}")
                                for v in range(1, most + 1) for name in ("user", "value", "difference", "time")]).drop("entry")


def returns_by_owner(audits: DataFrame, draws: DataFrame, keys: list[str], manifests: DataFrame) -> DataFrame:
    """Returns entered by a manifest's owner and by others, per manifest and draw, side by side; either may be missing.

    ``draws`` has the weekday and the draw amount, ``manifests`` a row per account, weekday and manifest with
    its owner. Entries are summed by draw and user first, so a hot account meets the manifests as few rows, and
    ``split_join`` lets its partition be split. One grouping with two conditional sums gives what a full join
    of two aggregates gives.
    """
    by_user = with_amount(audits).groupBy(*keys, "audit_user_id").agg(F.sum("amount").alias("amount"))
    rows = split_join(split_join(by_user, draws, keys), manifests, ["account_id", "draw_weekday"])
    mine = F.col("audit_user_id") == F.col("owner_id")
    return rows.groupBy("mfst_code", *keys, "draw_amount").agg(
        F.sum(F.when(mine, F.col("amount"))).alias("owner_returns"),
        F.sum(F.when(~mine, F.col("amount"))).alias("admin_returns"))


def audit_mismatch(draws: DataFrame, audits: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Draws whose value is not the value of their last audit entry."""
    last = latest(with_amount(audits).select(*keys, "audit_id", "amount", "audit_user_id"), keys, "audit_id")
    return draws.join(last, keys).where(F.col(measure) != F.col("amount"))


def multiple_returns(audits: DataFrame, keys: list[str]) -> DataFrame:
    return first_last(with_amount(audits), keys, "audit_id", ["amount", "audit_user_id"])


def decremented(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Draws whose second entry is below the first."""
    rows = with_amount(audits)
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("audit_id") == 1, F.col("amount"))).alias("first_amount"),
        F.max(F.when(F.col("audit_id") == 2, F.col("amount"))).alias("second_amount")).where("second_amount < first_amount")


def write_off(draws: DataFrame, audits: DataFrame, keys: list[str], user: int) -> tuple[DataFrame, DataFrame]:
    """Set the admin adjustment to minus the net, and one audit entry per draw numbered above those on file.

    Returns (new draws, audit entries to append).
    """
    net = net_sales()
    changed = draws.withColumn("adj_admin_amount", zero("adj_admin_amount") - net)
    entries = next_version(changed, audits, keys, "audit_id", "audit_id").select(
        *keys, "audit_id", F.lit(user).alias("audit_user_id"), F.lit("AdjAdminAmount").alias("audit_field"),
        F.col("adj_admin_amount").cast("string").alias("audit_value"))
    return changed, entries


def returns_from_audit(draws: DataFrame, audits: DataFrame, keys: list[str]) -> DataFrame:
    """Returns set to the value of the last audit entry, where there is one."""
    last = latest(with_amount(audits).select(*keys, "audit_id", F.col("amount").alias("__last")), keys, "audit_id")
    return (draws.join(last.drop("audit_id"), keys, "left")
            .withColumn("ret_amount", F.coalesce(F.col("__last").cast("bigint"), F.col("ret_amount"))).drop("__last"))


def multiple_changes(history: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows of draws that were changed more than once."""
    often = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes")).where("changes > 1")
    return split_join(history, often, keys)
