"""Daily load: text rows to canonical rows, then inserts, updates, history and fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.operators.changes import classify_load
from pressroute.operators.aggregates import unpivot_week
from pressroute.operators.joins import anti, match, with_weekday_dates
from pressroute.session import shared_folder
from pressroute.sources.tables import staged


def normalise_load(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Trim, default and cast raw load columns to the canonical load schema.

    Account codes hold the id after a letter; an empty rate means zero. A number or date that cannot be
    read becomes null; ``load_rejects`` reports such rows.
    """
    code = F.trim(F.coalesce("acct_code", F.lit("")))
    pub = F.trim(F.coalesce("pub_code", F.lit("")))
    date = F.try_to_timestamp("draw_date", F.lit("MM/dd/yyyy")).cast("date")
    return raw.select(
        *(keep or []), F.substr(code, F.lit(2)).try_cast("bigint").alias("account_id"),
        F.substr(pub, F.lit(2)).try_cast("bigint").alias("publication_id"),
        date.alias("draw_date"), date.alias("delivery_date"), F.dayofweek(date).alias("draw_weekday"),
        F.when(F.coalesce(F.trim("draw_amount"), F.lit("")) == "", 0).otherwise(F.trim("draw_amount").try_cast("bigint")).alias("draw_amount"),
        F.when(F.coalesce(F.trim("draw_rate"), F.lit("")) == "", 0).otherwise(F.trim("draw_rate").try_cast("decimal(8,5)")).cast("decimal(8,5)").alias("draw_rate"))


def load_rejects(raw: DataFrame) -> DataFrame:
    """Raw rows that ``normalise_load`` cannot read, with the names of the columns at fault."""
    columns = {"acct_code": "account_id", "pub_code": "publication_id", "draw_date": "draw_date", "draw_amount": "draw_amount", "draw_rate": "draw_rate"}
    read = normalise_load(raw.withColumn("__raw", F.struct(*raw.columns)), keep=["__raw"])
    faults = F.concat_ws(", ", *[F.when(F.col(new).isNull(), F.lit(old)) for old, new in columns.items()])
    return read.withColumn("faults", faults).where("faults <> ''").select("__raw.*", "faults")


def wide_to_long(load: DataFrame, keys: list[str]) -> DataFrame:
    """Load file with one column per weekday to one row per day with an amount."""
    return unpivot_week(load, keys, "draw_amount")


def split_repeated(load: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to load, report of what was left out): a load keeps one row per key.

    Of repeated rows the one with the highest other values stays, so a repeated run keeps the same.
    """
    rest = [c for c in load.columns if c not in keys]
    grouped = load.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    return (grouped.select(*keys, "__row.*").select(load.columns),
            grouped.where("__n > 1").select(*keys, (F.col("__n") - 1).alias("removed")))


def on_file_dates(base: DataFrame, load: DataFrame, date: str = "draw_date") -> tuple[DataFrame, DataFrame]:
    """(rows on a date of the load, all others). A daily load touches a few dates of the table.

    The load's dates are no more than the calendar's days, which is why they may be broadcast. Their span,
    worked out before the scan, is a filter on it; where the table is kept in month folders
    (``write_by_month``) the span of months is one, too, and the folders of other months are not read.
    """
    days = load.select(date).where(F.col(date).isNotNull()).distinct()
    on = [date]
    if "month" in base.columns:
        days, on = days.withColumn("month", F.date_format(date, "yyyy-MM")), [date, "month"]
    near = base
    for c in on:
        near = near.where(F.col(c).between(days.agg(F.min(c)).scalar(), days.agg(F.max(c)).scalar()))
    listed = F.broadcast(days)
    return near.join(listed, on, "left_semi").select(base.columns), base.join(listed, on, "left_anti").select(base.columns)


def fold_load(base: DataFrame, load: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each key of either side once, with ``old_x``, ``new_x``, its ``action`` (insert, update, same or missing from the
    load) and how many rows ``__n`` the load has for it, of which the one with the highest values counts.

    The sides are stacked and folded in one aggregate with map-side combine; nothing is joined.
    """
    kinds = {c: base.schema[c].dataType for c in columns}
    values = F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
    nothing = F.lit(None)
    of_base = base.select(*keys, values.alias("old"), nothing.cast(f"struct<{', '.join(f'{c}: {kinds[c].simpleString()}' for c in columns)}>").alias("new"))
    of_load = load.select(*keys, nothing.cast(of_base.schema["old"].dataType).alias("old"), values.alias("new"))
    folded = of_base.unionByName(of_load).groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"), F.count("new").alias("__n"))
    action = (F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "missing")
              .when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update"))
    return folded.select(*keys, *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in columns], action.alias("action"), "__n")


def import_draws(base: DataFrame, load: DataFrame, defaults: DataFrame, keys: list[str], changed_at: Column,
                 change_type: int, folder: str | None = None, fill: bool = False) -> dict[str, DataFrame]:
    """Load a file into the dated draws.

    ``changed``: the table's rows on the dates of the file, after the load: what replaces those dates.
    ``untouched``: the rows on other dates, which take no part in the join. ``table``: both.
    ``history``: one audit row per update and insert. ``duplicates``: keys that the file held more than
    once, of which one row was loaded. ``missing``: default amounts for pairs due on a date of the file
    that the file does not hold; with ``fill`` they are inserted, with a history row each.

    Amount and rate are compared, and the delivery date where both sides have one. The load is written once, since its
    dates pick the table's rows. Rows of the file and of the table on its dates are stacked and folded by key in one
    aggregate, which decides; the counts of table changes and history rows agree because both come from it.
    With a ``folder`` its result is written there first, so that writing all outputs folds once.
    """
    spark = base.sparkSession
    columns = ["draw_amount", "draw_rate"] + (["delivery_date"] if "delivery_date" in base.columns and "delivery_date" in load.columns else [])
    load = staged(load, shared_folder(spark, "import-load"))
    touched, untouched = on_file_dates(base.select(*keys, *columns), load)
    classed = fold_load(touched, load, keys, columns)
    if folder is not None:
        classed = staged(classed, folder)
    duplicates = classed.where("__n > 1").select(*keys, (F.col("__n") - 1).alias("removed"))
    changed = classed.select(*keys, *[
        F.when(F.col("action").isin("insert", "update"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
        for c in columns])
    history = classed.where(F.col("action").isin("insert", "update")).select(
        *keys, changed_at.alias("changed_at"), F.lit(change_type).alias("change_type_id"), "action",
        *[F.coalesce(F.col(f"old_{c}"), F.col(f"new_{c}")).alias(f"old_{c}") for c in columns],
        *[f"new_{c}" for c in columns])
    missing = due_but_absent(changed, load, defaults, keys)
    if fill:
        due = missing.withColumn("delivery_date", F.col("draw_date")).select(*keys, *columns)
        changed = changed.unionByName(due)
        history = history.unionByName(due.select(
            *keys, changed_at.alias("changed_at"), F.lit(change_type).alias("change_type_id"), F.lit("fill").alias("action"),
            *[F.col(c).alias(f"old_{c}") for c in columns], *[F.col(c).alias(f"new_{c}") for c in columns]))
    return {"table": untouched.unionByName(changed), "changed": changed, "untouched": untouched, "history": history,
            "missing": missing, "duplicates": duplicates}


# Fixed value: change type of a load.
BY_IMPORT = 1


def import_defaults(template: DataFrame, load: DataFrame, existing: DataFrame, changed_at: Column) -> dict[str, DataFrame]:
    """Load a file into the weekday template: the first step of the nightly import.

    Of several dates on one weekday the latest counts. ``table``: the new template, changed rows and rows
    it lacked included. ``history``: one row per change, numbered above the versions in ``existing``
    (keys and ``version``); a new row starts from zero with version 1.
    """
    keys, columns = ["account_id", "publication_id", "draw_weekday"], ["draw_amount", "draw_rate"]
    newest = load.withColumn("draw_weekday", F.dayofweek("draw_date")).groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct("draw_date", *columns)).alias("__row")).select(*keys, "__row.*")
    classed = classify_load(template, newest, keys, columns)
    table = classed.select(*keys, *[F.when(F.col("action").isin("insert", "update"), F.col(f"new_{c}")).otherwise(
        F.col(f"old_{c}")).alias(c) for c in columns])
    moved = classed.where(F.col("action").isin("insert", "update"))
    rows = moved.select(*keys, "action", changed_at.alias("changed_at"), F.lit(BY_IMPORT).alias("change_type_id"),
                        *[F.coalesce(F.col(f"old_{c}"), F.lit(0).cast(moved.schema[f"old_{c}"].dataType)).alias(f"old_{c}") for c in columns],
                        *[f"new_{c}" for c in columns])
    return {"table": table, "history": history_with_version(rows, existing, keys)}


def due_but_absent(table: DataFrame, load: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Default rows for each processing date of the load on which the pair has no dated row."""
    due = with_weekday_dates(defaults.select("account_id", "publication_id", "draw_weekday", "draw_amount", "draw_rate"),
                             load.select(F.col("delivery_date").alias("draw_date")))
    return anti(due, table, keys)


def history_with_version(history: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Number each audit row one above the highest version on file for its key."""
    top = existing.groupBy(*keys).agg(F.max("version").alias("__top"))
    return match(history, top, keys, "left").withColumn(
        "version", F.coalesce(F.col("__top"), F.lit(0)) + 1).drop("__top")


def processing_list(load: DataFrame) -> DataFrame:
    """'P1 (01/02, 01/03), P2 (01/02)': the dates of each publication in the file, one row per publication."""
    return load.groupBy("publication_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.date_format("draw_date", "yyyy-MM-dd"))), ", ").alias("dates"))
