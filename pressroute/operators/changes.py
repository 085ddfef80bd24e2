"""Table changes as new DataFrames: updates, loads, deletes, duplicate removal, retention.

Nothing is changed in place. Each function returns the new table, or the parts to append.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.operators.joins import anti, split_join


def changed_rows(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``df`` that the change set really alters, old values as ``old_x``, new ones as ``new_x``."""
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = split_join(df, new, keys)
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in columns])
    return joined.where(differs).select(
        *[c for c in df.columns if c not in columns],
        *[F.col(c).alias(f"old_{c}") for c in columns], *[f"new_{c}" for c in columns])


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a check to the plan: a repeated key fails the job when it runs."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                    *[F.first(c).alias(c) for c in df.columns if c not in keys])
    one = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"repeated key in change set: {keys}")).cast("int")).otherwise(1)
    return counted.where(one == 1).select(*df.columns)


def apply_updates(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str],
                  keep_null: bool = False) -> DataFrame:
    """``update .. from``: matched rows take the new values. Change keys must be unique.

    A null in the change set leaves the old value unless ``keep_null`` is set.
    """
    new = assert_unique(changes.select(*keys, *columns), keys).select(
        *keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = split_join(df, new, keys, "left")
    for c in columns:
        value = F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if keep_null \
            else F.coalesce(F.col(f"__{c}"), F.col(c))
        joined = joined.withColumn(c, value)
    return joined.select(*df.columns)


def apply_with_history(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str],
                       changed_at: Column, change_type: int) -> tuple[DataFrame, DataFrame]:
    """New table and the audit rows. Both come from one changed set, so their counts agree."""
    unique = assert_unique(changes.select(*keys, *columns), keys)
    history = changed_rows(df, unique, keys, columns).select(
        *keys, changed_at.alias("changed_at"), F.lit(change_type).alias("change_type_id"),
        *[f"{side}_{c}" for c in columns for side in ("old", "new")])
    return apply_updates(df, changes, keys, columns), history


def classify_load(base: DataFrame, load: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One full join that classes each key: insert, update, same, or missing from the load."""
    b = base.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"old_{c}") for c in columns])
    l = load.select(*keys, F.lit(True).alias("__l"), *[F.col(c).alias(f"new_{c}") for c in columns])
    same = reduce(Column.__and__, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns])
    action = (F.when(F.col("__b").isNull(), "insert").when(F.col("__l").isNull(), "missing")
              .when(same, "same").otherwise("update"))
    return b.join(l, keys, "full").withColumn("action", action).drop("__b", "__l")


def insert_missing(dim: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the table lacks, one per key."""
    return anti(source.dropDuplicates(keys), dim, keys)


def delete_keys(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return anti(df, doomed, keys)


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame,
                   relations: list[tuple[str, list[str]]]) -> dict[str, DataFrame]:
    """Remove the doomed keys from child to parent tables. ``relations`` lists (table, key columns)."""
    out = dict(tables)
    for name, keys in relations:
        out[name] = split_join(out[name], doomed.select(*keys).distinct(), keys, "left_anti")
    return out


def dedupe_keep_first(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Row with the lowest id of each key, as one aggregate; no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def dedupe_any(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dedupe_drop_latest(df: DataFrame, keys: list[str], by: str, eligible: Column) -> DataFrame:
    """Of keys with several eligible rows, drop the row with the highest id."""
    repeated = df.where(eligible).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    newest = split_join(df, repeated.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max(by).alias(by))
    return anti(df, newest, [*keys, by])


def dedupe_prefer(df: DataFrame, keys: list[str], drop_when: Column) -> DataFrame:
    """Of keys with several rows, drop the rows that meet the condition. Keys must not be null."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return split_join(df, sizes, keys).where(~(F.coalesce(drop_when, F.lit(False)) & (F.col("__n") > 1))).select(df.columns)


def retention_split(df: DataFrame, date: str, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """(archive, live): rows inside the closed range, and all others. A null date stays live."""
    inside = F.col(date).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    return df.where(inside), df.where(~F.coalesce(inside, F.lit(False)))


def restore(df: DataFrame, backup: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Backup values for matched rows, and backup rows the table lost."""
    fixed = apply_updates(df, backup, keys, columns, keep_null=True)
    return fixed.unionByName(anti(backup.select(*df.columns), df, keys))
