"""Manifest templates, sequences and dated manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroute.functions.bits import day_flags, day_list, freq_matches
from pressroute.functions.text import zero_pad
from pressroute.functions.values import case_map, net_sales
from pressroute.operators.aggregates import flatten_week
from pressroute.operators.filters import optional_eq
from pressroute.operators.joins import anti, join_on_schedule, on_weekday, pair_with_dates, split_join
from pressroute.sources.frames import MANIFEST_TYPES


def template_code(column="template_id"):
    return F.concat(F.lit("MT"), zero_pad(column, 3))


def manifest_assignments(assignments: DataFrame, accounts: DataFrame, type_name: str | None = None,
                         acct_code: str | None = None, pub: str | None = None, mask: int | None = None) -> DataFrame:
    """Which account and publication is on which manifest. Arguments left out keep every row."""
    out = (assignments.join(accounts.select("account_id", "acct_code", "owner_id"), "account_id")
           .withColumn("mfst_code", template_code())
           .withColumn("type_name", case_map("manifest_type_id", MANIFEST_TYPES)))
    out = optional_eq(optional_eq(optional_eq(out, "type_name", type_name), "acct_code", acct_code), "pub_short_name", pub)
    return out if mask is None else out.where(F.col("frequency").bitwiseAND(mask) > 0)


def draws_by_brand(lines: DataFrame, publications: DataFrame) -> DataFrame:
    """Draw and net per account, brand and date: aggregated before the schedule joins them.

    The join to publications comes first: (account, publication, date) hardly repeats, so an
    aggregate before it would only add a shuffle, and a hot publication is split by the
    adaptive join. The combine then runs in the join's own tasks.
    """
    return (lines.withColumn("net", net_sales()).select("account_id", "publication_id", "draw_date", "draw_weekday", "draw_amount", "net")
            .join(publications.select("publication_id", "brand_no"), "publication_id")
            .groupBy("account_id", "brand_no", "draw_date", "draw_weekday").agg(
                F.sum("draw_amount").alias("draw_amount"), F.sum("net").alias("net")))


def net_by_manifest(lines: DataFrame, publications: DataFrame, assignments: DataFrame) -> DataFrame:
    """Draw and net of each template by date. The mask test is an equality on the weekday.

    One aggregate at the end: templates and dates are few, so the combine before its shuffle
    leaves little to move, and the fact rows are shuffled only where a join has to.
    """
    rows = (lines.select("account_id", "publication_id", "draw_date", "draw_weekday", "draw_amount", net_sales().alias("net"))
            .join(publications.select("publication_id", "brand_no"), "publication_id"))
    return join_on_schedule(rows, assignments, ["account_id", "brand_no"]).groupBy("template_id", "draw_date").agg(
        F.count(F.lit(1)).alias("drops"), F.sum("draw_amount").alias("draw_amount"), F.sum("net").alias("net"))


def draw_by_manifest_day(facts: DataFrame, assignments: DataFrame, dated: DataFrame) -> DataFrame:
    """Draws of a template by day, found through the schedule or through a dated manifest, each once.

    Items are unique per template and account-brand, with their masks united. Facts meet the days in the mask
    by an equality on the weekday; only the days outside it, of templates that have a dated manifest, go on to
    the dated manifests. The two are disjoint, so nothing has to be made distinct.
    """
    keys, out = ["account_id", "brand_no"], ["template_id", "account_id", "brand_no", "draw_date", "draw_amount", "net"]
    items = assignments.groupBy("template_id", *keys).agg(F.bit_or("frequency").alias("frequency"))
    outside = items.join(dated.select("template_id").distinct(), "template_id", "left_semi").withColumn(
        "frequency", F.lit(127).bitwiseAND(F.bitwise_not("frequency")))
    days = dated.select("template_id", F.col("manifest_date").alias("draw_date")).distinct()
    scheduled = join_on_schedule(facts, items, keys).select(out)
    by_date = join_on_schedule(facts, outside, keys).join(days, ["template_id", "draw_date"], "left_semi").select(out)
    return scheduled.unionByName(by_date)


def draw_by_dated_sequence(facts: DataFrame, history: DataFrame, dated: DataFrame) -> DataFrame:
    """Draws of a template by day, each once: through its present items by their masks, or through a dated manifest by the
    items that it had on its date.

    ``history`` has the items of all times (``template_id``, keys, ``frequency``, ``valid_from`` and ``valid_to``, the first
    day without the item; null for no limit), so an item that has left its template still shows on the manifests
    of its days. Facts meet the items of their account and brand in one equi-join, whose partitions adaptive
    execution splits for a hot account; whether a day has a manifest is a join on template and date.
    """
    keys, out = ["account_id", "brand_no"], ["template_id", "account_id", "brand_no", "draw_date", "draw_amount", "net"]
    days = dated.select("template_id", F.col("manifest_date").alias("draw_date")).distinct().withColumn("__dated", F.lit(True))
    # The history is exploded from a smaller table, which the planner sizes it by: shuffled, not broadcast.
    met = facts.join(history.select("template_id", *keys, "frequency", "valid_from", "valid_to").hint("merge"), keys)
    day = F.call_function("shiftleft", F.lit(1), F.col("draw_weekday") - 1)
    scheduled = F.col("valid_to").isNull() & (F.col("frequency").bitwiseAND(day) > 0)
    then = (F.coalesce(F.col("draw_date") >= F.col("valid_from"), F.lit(True))) & F.coalesce(F.col("draw_date") < F.col("valid_to"), F.lit(True))
    marked = met.withColumns({"__scheduled": scheduled, "__then": then}).where("__scheduled or __then")
    shown = marked.join(days, ["template_id", "draw_date"], "left").where(F.col("__scheduled") | (F.col("__then") & F.col("__dated")))
    return shown.select(out).distinct()


def finalize(assignments: DataFrame, dated: DataFrame, start: str, stop: str) -> DataFrame:
    """Manifests to add: each template and date of the range that its masks hold and that is not there yet."""
    per_day = on_weekday(assignments, "frequency", "draw_weekday").groupBy("template_id", "draw_weekday").agg(
        F.count(F.lit(1)).alias("items"))
    wanted = (pair_with_dates(per_day, start, stop, "manifest_date")
              .where(F.dayofweek("manifest_date") == F.col("draw_weekday")))
    return anti(wanted, dated, ["template_id", "manifest_date"])


def sequence_matrix(assignments: DataFrame) -> DataFrame:
    """Sequence per weekday in seven columns, and whether the days differ."""
    days = on_weekday(assignments, "frequency", "weekday")
    differs = (F.min("sequence") != F.max("sequence")).cast("int").alias("differs")
    return flatten_week(days, ["template_id", "account_id"], "weekday", {"sequence": "seq_"}, extra=(differs,))


def unassigned(pairs: DataFrame, assignments: DataFrame, manifest_type: int | None = None) -> DataFrame:
    """Account-publication pairs on no manifest, or on none of a type."""
    used = optional_eq(assignments, "manifest_type_id", manifest_type)
    keys = ["account_id", "brand_no"]
    # Assignments are exploded from a smaller table, which the planner sizes them by: shuffled, not broadcast.
    return split_join(pairs, used.select(*keys).distinct().hint("merge"), keys, "left_anti")


def fill_gaps(assignments: DataFrame, brands: DataFrame) -> DataFrame:
    """Publications an account takes that its sequence lacks, with the account's place in the sequence.

    Accounts whose items hold several places (split) are left for ``align_to_group``.
    """
    places = assignments.groupBy("sequence_id", "account_id").agg(
        F.min("sequence").alias("sequence"), F.max("sequence").alias("__high"))
    whole = places.where(F.col("sequence") == F.col("__high")).drop("__high")
    wanted = whole.join(brands.select("account_id", "brand_no").distinct(), "account_id")
    return anti(wanted, assignments, ["sequence_id", "account_id", "brand_no"])


def frequency_report(assignments: DataFrame) -> DataFrame:
    """Masks of a template added up as the report does, and as a union that no repeat can spoil."""
    masks = assignments.select("template_id", "frequency").distinct()
    return masks.groupBy("template_id").agg(
        F.sum("frequency").alias("frequency_sum"), F.bit_or("frequency").alias("frequency_union")).withColumn(
        "day_list", day_list("frequency_union"))


def assignments_flat(assignments: DataFrame) -> DataFrame:
    return assignments.select("account_id", template_code().alias("mfst_code"), "sequence_id", "pub_short_name",
                              "frequency", day_list("frequency").alias("day_list"), *day_flags("frequency"))


def consolidate(assignments: DataFrame) -> DataFrame:
    """One seven-day sequence per template that has several; each account keeps its highest place."""
    several = assignments.groupBy("template_id").agg(F.count_distinct("sequence_id").alias("__n")).where("__n > 1")
    items = split_join(assignments, several.select("template_id"), ["template_id"], "left_semi")
    top = items.groupBy("template_id", "account_id").agg(F.max("sequence").alias("sequence"))
    return (items.select("template_id", "account_id", "brand_no").distinct()
            .join(top, ["template_id", "account_id"]).withColumn("frequency", F.lit(127)))


def replicate(assignments: DataFrame, source_type: int, target_type: int, old: str, new: str) -> DataFrame:
    """Templates of one type copied as another type under renamed codes."""
    return (assignments.where(F.col("manifest_type_id") == source_type)
            .select("template_id", "sequence_id", "account_id", "brand_no", "frequency", "sequence").distinct()
            .withColumn("mfst_code", F.replace(template_code(), F.lit(old), F.lit(new)))
            .withColumn("manifest_type_id", F.lit(target_type)))


def report_by_account(assignments: DataFrame) -> DataFrame:
    """Delivery manifests of an account on weekdays, Saturday and Sunday, and its collection or returns manifest."""
    code, freq, kind = template_code(), F.col("frequency"), F.col("manifest_type_id")
    delivery = kind == 1
    return assignments.groupBy("account_id").agg(
        F.max(F.when(delivery & freq_matches(freq, 62), code)).alias("daily"),
        F.max(F.when(delivery & freq_matches(freq, 64), code)).alias("sat"),
        F.max(F.when(delivery & freq_matches(freq, 1), code)).alias("sun"),
        F.max(F.when(kind.isin(2, 4), code)).alias("returns"))


def split_accounts(assignments: DataFrame) -> DataFrame:
    """Accounts on several manifests of one type."""
    return (assignments.groupBy("account_id", "manifest_type_id").agg(F.count_distinct("template_id").alias("manifests"))
            .where("manifests > 1"))


def drop_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("template_id", "sequence_id").agg(F.count(F.lit(1)).alias("drops"))


def manifests_by_weekday(assignments: DataFrame) -> DataFrame:
    days = on_weekday(assignments.withColumn("code", template_code()), "frequency", "weekday")
    return flatten_week(days, ["account_id", "brand_no", "manifest_type_id"], "weekday", {"code": ""})


def compare_days(assignments: DataFrame, first: int, second: int) -> DataFrame:
    """Places on the manifest of two weekdays side by side; an item may be on one only."""
    days = on_weekday(assignments, "frequency", "weekday").where(F.col("weekday").isin(first, second))
    return days.groupBy("template_id", "account_id", "brand_no").agg(
        F.max(F.when(F.col("weekday") == first, F.col("sequence"))).alias("first_place"),
        F.max(F.when(F.col("weekday") == second, F.col("sequence"))).alias("second_place"))


def not_all_assigned(assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accounts with fewer publications on delivery manifests of a mask than they take."""
    assigned = assignments.where("manifest_type_id = 1").groupBy("account_id", "frequency").agg(
        F.count(F.lit(1)).alias("assigned"))
    taken = pairs.select("account_id", "brand_no").distinct().groupBy("account_id").agg(F.count(F.lit(1)).alias("taken"))
    return assigned.join(taken, "account_id").where("assigned < taken")


def manifest_history(assignments: DataFrame, dated: DataFrame) -> DataFrame:
    """First and last date and number of dated manifests that each account and publication was on.

    Dates are summed per template and weekday before the items join.
    """
    runs = dated.groupBy("template_id", "draw_weekday").agg(
        F.min("manifest_date").alias("lo"), F.max("manifest_date").alias("hi"), F.count(F.lit(1)).alias("n"))
    return (on_weekday(assignments.select("template_id", "account_id", "brand_no", "frequency").distinct())
            .select("template_id", "account_id", "brand_no", "draw_weekday").distinct()
            .join(runs, ["template_id", "draw_weekday"])
            .groupBy("template_id", "account_id", "brand_no").agg(
                F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), F.sum("n").alias("manifests")))
