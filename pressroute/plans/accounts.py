"""Account lists, dumps, ownership and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.functions.values import null_safe_ne
from pressroute.operators.aggregates import csv_agg, flatten_week
from pressroute.operators.joins import anti, split_join
from pressroute.operators.ordered import assign_ids
from pressroute.plans.schedules import template_code


def account_list(accounts: DataFrame, rollups: DataFrame, types: DataFrame) -> DataFrame:
    """Rollups, child accounts and stand-alone accounts, classed and stacked."""
    typed = accounts.join(types, "account_type_id")
    kind = F.when(F.col("rollup_id").isNotNull(), "Child").otherwise("Stand-Alone")
    heads = rollups.select(F.col("rollup_code").alias("acct_code"), F.lit("Rollup").alias("kind"),
                           F.lit(None).cast("string").alias("account_type"))
    return heads.unionByName(typed.select("acct_code", kind.alias("kind"), F.col("type_name").alias("account_type")))


def rollup_children(accounts: DataFrame, rollups: DataFrame) -> DataFrame:
    """Rollups with the number of their children, those without any included."""
    counts = accounts.where("rollup_id is not null").groupBy("rollup_id").agg(F.count(F.lit(1)).alias("n"))
    return rollups.join(counts, "rollup_id", "left").select(
        "rollup_code", F.coalesce("n", F.lit(0)).alias("children"))


def account_dump(accounts: DataFrame, rollups: DataFrame, categories: DataFrame, assignments: DataFrame, defaults: DataFrame) -> DataFrame:
    """Active accounts by publication: class, rollup, category, manifests as a list, highest default draw by weekday.

    ``defaults`` has the publication's short name. The week is laid out per account and publication in one
    grouping before the account's columns, a row per account, join.
    """
    manifests = csv_agg(assignments.withColumn("mfst_code", template_code()), ["account_id"], "mfst_code", name="manifests")
    week = flatten_week(defaults, ["account_id", "pub_short_name"], "draw_weekday", {"draw_amount": "draw_"}, F.max)
    kind = F.when(F.col("rollup_id").isNotNull(), "Child Account").otherwise("Stand-Alone")
    heads = (accounts.where("active = 1").join(rollups.select("rollup_id", "rollup_code"), "rollup_id", "left")
             .join(categories, "account_type_id", "left").join(manifests, "account_id", "left")
             .select("account_id", "acct_code", "postal_code", kind.alias("account_kind"), "rollup_code", F.col("type_name").alias("category"), "manifests"))
    return split_join(week, heads, ["account_id"])


def rollup_mismatch(draws: DataFrame, accounts: DataFrame) -> DataFrame:
    """Draws of child accounts whose stored rollup is not the account's rollup."""
    home = accounts.where("rollup_id is not null").select("account_id", F.col("rollup_id").alias("account_rollup"))
    return draws.join(home, "account_id").where(F.coalesce("rollup_id", F.lit(0)) != F.col("account_rollup"))


def owner_audit(assignments: DataFrame, accounts: DataFrame, pairs: DataFrame, template_owner: Column) -> DataFrame:
    """Owners that differ between template, account and account-publication; a missing owner differs."""
    rows = (assignments.select("template_id", "account_id", "brand_no").distinct()
            .withColumn("template_owner", template_owner)
            .join(accounts.select("account_id", F.col("owner_id").alias("account_owner")), "account_id")
            .join(pairs.select("account_id", "brand_no", "ap_owner_id").distinct(), ["account_id", "brand_no"]))
    return rows.where(null_safe_ne("template_owner", "account_owner") | null_safe_ne("template_owner", "ap_owner_id"))


def new_categories(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Categories for names that have none yet, numbered on from the highest id."""
    fresh = anti(names.select("category").distinct(), categories, ["category"])
    return assign_ids(fresh, categories.agg(F.max("category_id")), ["category"], "category_id")


def sync_categories(account_categories: DataFrame, wanted: DataFrame, placeholder: str) -> DataFrame:
    """Account categories with missing ones added, and the placeholder dropped where another exists."""
    keys = ["account_id", "category"]
    every = account_categories.select(*keys).unionByName(wanted.select(*keys)).distinct()
    real = every.where(F.col("category") != placeholder).select("account_id").distinct().withColumn("__real", F.lit(True))
    return (every.join(real, "account_id", "left")
            .where((F.col("category") != placeholder) | F.col("__real").isNull()).drop("__real"))
