"""Return cutoffs and rules by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.functions.dates import period_start, return_cutoff
from pressroute.functions.values import net_sales, zero
from pressroute.operators.joins import pair_all, pair_with_dates

DEFAULT_DAYS = 7


FIELDS = ["period_start_date", "period_length", "cutoff_day"]


def with_rule(dimension: DataFrame, rules: DataFrame, key: str, tag: str) -> DataFrame:
    """A dimension with its own rule in tagged columns, so that facts need no join of their own for it."""
    return dimension.join(rules.select(key, *[F.col(f).alias(f"__{tag}_{f}") for f in FIELDS]), key, "left")


def picked_rule(system: dict | None = None) -> list:
    """Rule name and fields by precedence: account type, publication, system, none."""
    s = {f: F.lit((system or {}).get(f)).cast(kind) for f, kind in zip(FIELDS, ("date", "int", "int"))}
    by_type, by_pub = F.col("__t_period_length").isNotNull(), F.col("__p_period_length").isNotNull()
    name = (F.when(by_type, "Acct Type").when(by_pub, "Publication")
            .when(s["period_length"].isNotNull(), "System").otherwise("Default"))
    return [name.alias("rule_type"), *[
        F.when(by_type, F.col(f"__t_{f}")).when(by_pub, F.col(f"__p_{f}")).otherwise(s[f]).alias(f) for f in FIELDS]]


def threshold_column(as_of: str):
    """Return cutoff under the rule of the row; without one, ``DEFAULT_DAYS`` before the date."""
    day = F.lit(as_of).cast("date")
    return F.when(F.col("rule_type") != "Default", return_cutoff(day, *FIELDS)).otherwise(F.date_sub(day, DEFAULT_DAYS))


def thresholds(types: DataFrame, publications: DataFrame, type_rules: DataFrame, pub_rules: DataFrame,
               as_of: str, system: dict | None = None) -> DataFrame:
    """Return cutoff for every account type and publication.

    Rules hold period_start_date, period_length and cutoff_day.
    """
    day = F.lit(as_of).cast("date")
    pairs = pair_all(with_rule(publications.select("publication_id"), pub_rules, "publication_id", "p"),
                     with_rule(types.select("account_type_id"), type_rules, "account_type_id", "t"))
    picked = pairs.select("account_type_id", "publication_id", *picked_rule(system))
    ruled = F.col("rule_type") != "Default"
    start = period_start(day, "period_start_date", "period_length")
    return picked.select(
        "account_type_id", "publication_id", "rule_type", *FIELDS,
        F.when(ruled, start).alias("current_period_start"),
        F.when(ruled, F.datediff(day, start)).alias("day_in_period"),
        F.when(ruled, F.date_add(start, F.col("cutoff_day").cast("int"))).alias("cutoff_date"),
        threshold_column(as_of).alias("return_threshold"))


def draw_entry(lines: DataFrame, assignments: DataFrame, accounts: DataFrame, publications: DataFrame,
               types: DataFrame, type_rules: DataFrame, pub_rules: DataFrame, system: dict | None,
               as_of: str, selected: str, first: str, last: str, template: int | None = None) -> DataFrame:
    """Entry sheet of a manifest: place, draw, net, and whether the draw is too old to change.

    The place is the account's highest on the template for the selected weekday. Facts are
    filtered by date first and joined twice: to the publications, and to the items with all
    that hangs on the account.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.dayofweek(F.lit(selected).cast("date")) - 1)
    todays = assignments.where(F.col("frequency").bitwiseAND(bit) > 0)
    if template is not None:
        todays = todays.where(F.col("template_id") == template)
    places = todays.groupBy("template_id", "account_id").agg(F.max("sequence").alias("drop_sequence"))
    typed = accounts.where("active = 1").join(types, "account_type_id").select(
        "account_id", "acct_code", "account_type_id", "type_name")
    items = (todays.select("template_id", "account_id", "brand_no").distinct().join(places, ["template_id", "account_id"])
             .join(with_rule(typed, type_rules, "account_type_id", "t"), "account_id"))
    titles = with_rule(publications.select("publication_id", "brand_no", "pub_short_name", "print_sort_order"),
                       pub_rules, "publication_id", "p")
    facts = lines.where(F.col("draw_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = facts.join(titles, "publication_id").join(items, ["account_id", "brand_no"])
    ruled = rows.select("*", *picked_rule(system))
    return ruled.select(
        "template_id", "drop_sequence", "acct_code", "type_name", "pub_short_name", "print_sort_order",
        "account_id", "publication_id", "draw_date", "draw_amount", zero("adj_amount").alias("adj_amount"),
        zero("adj_admin_amount").alias("adj_admin_amount"), zero("ret_amount").alias("ret_amount"),
        net_sales().alias("net"),
        F.when(F.col("draw_date") < threshold_column(as_of), 1).otherwise(0).alias("over_threshold"))


def resolve_rule(pairs: DataFrame, account_rules: DataFrame, category_rules: DataFrame, pub_rules: DataFrame) -> DataFrame:
    """Forecast rule of each account and publication: the account's, else its category's, else the publication's."""
    rows = (pairs.join(pub_rules.withColumnRenamed("rule_id", "__p"), "publication_id", "left")
            .join(category_rules.withColumnRenamed("rule_id", "__c"), "category", "left")
            .join(account_rules.withColumnRenamed("rule_id", "__a"), ["account_id", "publication_id"], "left"))
    kind = (F.when(F.col("__a").isNotNull(), "Account Rule").when(F.col("__c").isNotNull(), "Category Rule")
            .when(F.col("__p").isNotNull(), "Publication Rule").otherwise("No Rule"))
    return rows.withColumn("rule_type", kind).withColumn("rule_id", F.coalesce("__a", "__c", "__p")).drop("__a", "__c", "__p")


def cutoffs_over_range(rules: DataFrame, key: str, as_of: str, days_back: int = 42) -> DataFrame:
    """Return cutoff of each rule on the date and on each of the days before it, expanded in place."""
    last = F.lit(as_of).cast("date")
    rows = pair_with_dates(rules, F.date_sub(last, days_back - 1), last, "day")
    return rows.select(key, "day", return_cutoff("day", *FIELDS).alias("min_date"))


def forecast_floor(defaults: DataFrame, accounts: DataFrame, type_ids: list[int], floor: int) -> DataFrame:
    """Smallest forecast raised to a floor for accounts of some types."""
    hit = accounts.where(F.col("account_type_id").isin(type_ids)).select("account_id", F.lit(True).alias("__hit"))
    return (defaults.join(hit, "account_id", "left")
            .withColumn("forecast_min", F.when(F.col("__hit"), F.greatest("forecast_min", F.lit(floor))).otherwise(F.col("forecast_min")))
            .drop("__hit"))
