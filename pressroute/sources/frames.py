"""Canonical frames built from the given tables. All are lazy; none is cached."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressroute.functions.text import zero_pad
from pressroute.functions.values import case_map
from pressroute.sources.tables import inline_rows

# Account types and manifest types, id to name.
ACCOUNT_TYPES = [(0, "Dealer"), (1, "Rack"), (2, "Hotel"), (3, "School")]
MANIFEST_TYPES = {1: "Delivery", 2: "Collection", 4: "Returns"}
BRANDS = 25

DRAW_KEY = ["account_id", "publication_id", "draw_date"]
DAILY_KEY = ["account_id", "publication", "draw_date"]


class Frames:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")

    @cached_property
    def draw_lines(self) -> DataFrame:
        """Delivery facts as scanned: no shuffle, several rows per key possible."""
        line = self.table("lineitem")
        return line.select(
            F.col("l_suppkey").alias("account_id"),
            F.col("l_partkey").alias("publication_id"),
            F.to_date("l_shipdate").alias("draw_date"),
            F.dayofweek("l_shipdate").alias("draw_weekday"),
            F.col("l_quantity").cast("int").alias("draw_amount"),
            F.when(F.col("l_returnflag") == "R",
                   F.floor(F.col("l_quantity") * F.col("l_discount")).cast("int")).alias("ret_amount"),
            F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") - 4).alias("adj_amount"),
            F.when(F.col("l_returnflag") == "A", F.col("l_linenumber") % 3 - 1).alias("adj_admin_amount"),
            F.col("l_tax").cast("decimal(8,5)").alias("draw_rate"),
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("line_no"),
        )

    @cached_property
    def draws(self) -> DataFrame:
        """One row per account, publication and date. Repeats combine map-side before the shuffle."""
        lines = self.draw_lines
        return lines.groupBy(*DRAW_KEY, "draw_weekday").agg(
            F.date_add("draw_date", F.when(F.max("line_no") >= 6, 1).otherwise(0)).alias("delivery_date"),
            F.sum("draw_amount").alias("draw_amount"),
            F.sum("ret_amount").alias("ret_amount"),
            F.sum("adj_amount").alias("adj_amount"),
            F.sum("adj_admin_amount").alias("adj_admin_amount"),
            F.max("draw_rate").alias("draw_rate"),
            F.sum(F.when(F.col("line_no") % 3 != 0, F.col("ret_amount"))).alias("ret_export_last"),
            F.sum(F.when(F.col("line_no") % 2 == 0, F.col("adj_amount"))).alias("adj_export_last"),
            F.max(F.col("order_key") % 25).alias("rollup_id"),
            F.max(F.col("line_no") % 3).alias("last_change_type"),
        )

    @cached_property
    def default_draws(self) -> DataFrame:
        """Template amounts per account, publication and weekday."""
        line = F.col("line_no")
        return self.draw_lines.groupBy("account_id", "publication_id", "draw_weekday").agg(
            F.max("draw_amount").alias("draw_amount"),
            F.max("draw_rate").alias("draw_rate"),
            F.max(line % 2).alias("allow_forecasting"),
            F.min(line % 2).alias("allow_returns"),
            F.min(line % 3).alias("allow_adjustments"),
            F.min("draw_amount").alias("forecast_min"),
            F.max("draw_amount").alias("forecast_max"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Dense daily draws: account is the user, publication the event type."""
        ev = self.table("events")
        whole = F.floor("value")
        return ev.groupBy(
            F.col("user_id").alias("account_id"), F.col("event_type").alias("publication"),
            F.to_date("ts").alias("draw_date"), F.dayofweek("ts").alias("draw_weekday"),
        ).agg(
            F.sum(whole).alias("draw_amount"),
            F.sum(F.when(F.col("event_id") % 4 == 0, F.floor(F.col("value") / 2))).alias("ret_amount"),
            F.sum(F.when(F.col("event_id") % 5 == 0, 1)).alias("adj_amount"),
            F.sum(F.when(F.col("event_id") % 7 == 0, -1)).alias("adj_admin_amount"),
        )

    @cached_property
    def draw_exports(self) -> DataFrame:
        """When the returns and the adjustments of a daily draw were last exported: hours after the entry, the latter a day later."""
        i = F.col("event_id")
        later = F.make_dt_interval(hours=(i % 40).cast("int"))
        return self.table("events").groupBy(
            F.col("user_id").alias("account_id"), F.col("event_type").alias("publication"), F.to_date("ts").alias("draw_date")).agg(
            F.max(F.when(i % 4 == 0, F.col("ts") + later)).alias("ret_exported_at"),
            F.max(F.when(i % 5 == 0, F.col("ts") + later + F.expr("interval 1 day"))).alias("adj_exported_at"))

    @cached_property
    def audit_events(self) -> DataFrame:
        """Audit entries without their version number."""
        return self.table("events").where(F.col("event_type").isin("click", "purchase")).select(
            F.col("user_id").alias("account_id"), F.col("event_type").alias("publication"),
            F.to_date("ts").alias("draw_date"), F.col("ts").alias("audit_time"), "event_id",
            (F.col("event_id") % 6).alias("audit_user_id"),
            F.floor("value").cast("string").alias("audit_value"))

    @cached_property
    def audits(self) -> DataFrame:
        """Audit entries of a daily draw, numbered 1, 2, 3 .. by time."""
        from pressroute.operators.ordered import numbered, ranges
        return numbered(self.audit_events, DAILY_KEY, ["audit_time", "event_id"], ranges(self.audit_events, "audit_time"), "audit_id")

    @cached_property
    def history(self) -> DataFrame:
        """Change log; the time is cut to the hour, so ties occur."""
        return self.table("events").select(
            F.col("event_id").alias("history_id"), F.col("user_id").alias("account_id"),
            F.col("event_type").alias("publication"), F.to_date("ts").alias("draw_date"),
            F.date_trunc("hour", "ts").alias("changed_at"),
            F.floor("value").alias("old_draw"),
            (F.floor("value") + F.col("event_id") % 5 - 2).alias("new_draw"),
            (F.col("event_id") % 4).alias("change_type_id"))

    @cached_property
    def accounts(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("acct_code"),
            F.col("s_nationkey").alias("owner_id"),
            F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("rollup_id"),
            (F.col("s_suppkey") % 4).cast("int").alias("account_type_id"),
            zero_pad(F.col("s_nationkey") * 397, 5).alias("postal_code"),
            (F.col("s_acctbal") >= 1000).cast("int").alias("active"),
            (F.col("s_suppkey") % 3 == 0).cast("int").alias("imported"))

    @cached_property
    def rollups(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("rollup_id"), F.col("n_name").alias("rollup_code"),
            F.col("n_regionkey").alias("region_id"))

    @cached_property
    def children(self) -> DataFrame:
        return self.accounts.where("rollup_id is not null").select(
            "rollup_id", F.col("account_id").alias("child_account_id"))

    @cached_property
    def account_types(self) -> DataFrame:
        return inline_rows(self.spark, ACCOUNT_TYPES, "account_type_id int, type_name string")

    @cached_property
    def publications(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("publication_id"), F.col("p_brand").alias("pub_short_name"),
            F.col("p_name").alias("pub_name"), F.col("p_type").alias("pub_type"),
            F.col("p_size").alias("print_sort_order"),
            F.expr("substring(p_brand, 7)").cast("int").alias("brand_no"))

    @cached_property
    def account_pubs(self) -> DataFrame:
        """Account-publication pairs, known by both ids."""
        a, p = F.col("account_id"), F.col("publication_id")
        return self.draw_lines.select("account_id", "publication_id").distinct().select(
            "account_id", "publication_id",
            F.when((a + p) % 11 != 0, 1).otherwise(0).alias("active"), (p % 25).alias("ap_owner_id"))

    @cached_property
    def account_brands(self) -> DataFrame:
        """Brands each account takes. Joined before the distinct, whose combine then leaves few rows to shuffle."""
        brands = self.publications.select("publication_id", "brand_no", "pub_short_name")
        return (self.draw_lines.select("account_id", "publication_id").join(brands, "publication_id")
                .select("account_id", "brand_no", "pub_short_name").distinct())

    @cached_property
    def assignments(self) -> DataFrame:
        """Sequence items: account and brand on a manifest template, with a weekday mask."""
        items = (self.table("supplier").select(F.col("s_suppkey").alias("account_id"))
                 .withColumn("brand_no", F.explode(F.sequence(F.lit(1), F.lit(BRANDS))))
                 .withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1)))))
        a, b, k = F.col("account_id"), F.col("brand_no"), F.col("slot")
        template = ((a * 3 + b % 2 + k * 17) % 40 + 1).cast("int")
        return items.where(((a + b + k) % 5 != 0) & ((a * 3 + b) % 10 != 0)).select(
            "account_id", "brand_no", F.concat(F.lit("Brand#"), b).alias("pub_short_name"),
            template.alias("template_id"), (template * 10 + k).alias("sequence_id"),
            F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), ((a + b) % 3 + 1).cast("int")).alias("manifest_type_id"),
            (1 + (a * 7 + b + k * 31) % 127).cast("int").alias("frequency"),
            ((a * 13 + template * 7) % 200 + F.when(b % 12 == 0, 1).otherwise(0)).cast("int").alias("sequence"))

    @cached_property
    def item_history(self) -> DataFrame:
        """Sequence items of all times: those of today, some of which came in 1996, and those that left with the end of that year."""
        a, b, k = F.col("account_id"), F.col("brand_no"), F.col("slot")
        template = ((a * 3 + b % 2 + k * 17) % 40 + 1).cast("int")
        gone = (self.table("supplier").select(F.col("s_suppkey").alias("account_id"))
                .withColumn("brand_no", F.explode(F.sequence(F.lit(1), F.lit(BRANDS))))
                .withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
                .where(((a + b + k) % 5 == 0) & ((a * 3 + b) % 10 != 0)))
        came = F.when((a + b) % 7 == 0, F.lit("1996-01-01").cast("date"))
        return self.assignments.select("template_id", "account_id", "brand_no", "frequency", came.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")).unionByName(
            gone.select(template.alias("template_id"), "account_id", "brand_no", (1 + (a * 7 + b + k * 31) % 127).cast("int").alias("frequency"),
                        F.lit(None).cast("date").alias("valid_from"), F.lit("1997-01-01").cast("date").alias("valid_to")))

    @cached_property
    def manifests(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("manifest_id"), F.to_date("o_orderdate").alias("manifest_date"),
            F.col("o_orderpriority").alias("mfst_code"), F.col("o_custkey").alias("owner_id"),
            case_map("o_orderstatus", {"F": 1, "O": 2, "P": 4}).alias("manifest_type_id"))

    @cached_property
    def dated_manifests(self) -> DataFrame:
        """Templates already turned into a manifest, by date."""
        date = F.to_date("o_orderdate")
        return self.table("orders").select(
            date.alias("manifest_date"), F.substring("o_orderpriority", 1, 1).cast("int").alias("template_id"),
            F.dayofweek(date).alias("draw_weekday")).distinct()

    @cached_property
    def system_log(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").alias("logged_at"), F.concat("event_type", F.lit(" "), "props").alias("message"),
            F.col("user_id").alias("group_id"), F.col("event_id").alias("log_id"))

    @cached_property
    def transfers(self) -> DataFrame:
        """Device transfers; which of the four times are set follows from the id."""
        i = F.col("event_id")
        secs = F.floor("value")

        def plus(ts, n):
            return ts + F.make_dt_interval(secs=n.cast("decimal(18,6)"))

        dl_start = F.when(i % 11 != 0, F.col("ts"))
        dl_end = F.when(i % 7 != 0, plus(dl_start, secs))
        ul_start = F.when(i % 4 != 0, plus(dl_end, (i % 30) * 3600))
        ul_end = F.when(i % 9 != 0, plus(ul_start, secs * 2))
        return self.table("events").select(
            i.alias("transfer_id"), F.col("user_id").alias("device_id"), F.to_date("ts").alias("mfst_date"),
            F.col("event_type").alias("mfst_code"), (i % 40 + 1).alias("drops"),
            dl_start.alias("dl_start"), dl_end.alias("dl_end"), ul_start.alias("ul_start"), ul_end.alias("ul_end"))

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("subscriber_plan_id"), F.col("o_custkey").alias("user_id"),
            (F.col("o_orderkey") % 6).alias("plan_id"), F.to_date("o_orderdate").alias("purchase_date"),
            F.date_add("o_orderdate", 365).alias("expires"),
            F.when(F.col("o_orderstatus") == "P", F.date_add("o_orderdate", 30)).alias("cancelled"))

    @cached_property
    def weblog(self) -> DataFrame:
        page = F.concat(F.lit("/c"), F.col("user_id") % 3,
                        F.when(F.col("event_type") == "signup", "/ack").otherwise("/drop"))
        return self.table("events").select(
            F.col("ts").alias("logged_at"), page.alias("page"),
            F.concat(F.lit("mfstid="), "user_id", F.lit("&dropid="), F.col("event_id") % 20).alias("query"))

    @cached_property
    def load_raw(self) -> DataFrame:
        """Load file rows as text, with stray blanks and codes in place of ids."""
        return self.draw_lines.where("line_no % 4 <> 0").groupBy(*DRAW_KEY).agg(
            F.sum(F.col("draw_amount") + F.when(F.col("order_key") % 2 == 0, 1).otherwise(0)).alias("amount"),
            F.max("draw_rate").alias("rate")).select(
            F.concat(F.lit("  A"), zero_pad("account_id", 6), F.lit(" ")).alias("acct_code"),
            F.concat(F.lit("P"), "publication_id").alias("pub_code"),
            F.date_format("draw_date", "MM/dd/yyyy").alias("draw_date"),
            F.col("amount").cast("string").alias("draw_amount"),
            F.when(F.col("rate") != 0, F.col("rate").cast("string")).alias("draw_rate"))

    @cached_property
    def manifest_file(self) -> DataFrame:
        """A circulation system's file, all text: codes in either case and padded, some rows that cannot be loaded."""
        line, order = self.table("lineitem"), F.col("l_orderkey")
        account = F.concat(F.lit("A"), zero_pad("l_suppkey", 6), F.lit("  "))
        return line.select(
            order.alias("file_order"), F.col("l_linenumber").alias("file_line"),
            F.when(order % 97 == 0, "13/45/1999").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("rundate"),
            F.when(order % 89 == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("drawtotal"),
            F.when(order % 79 == 0, " ").otherwise(F.concat(F.when(order % 2 == 0, "P").otherwise("p"), "l_partkey")).alias("productid"),
            F.when(order % 83 == 0, F.concat(F.lit("X"), account)).when(order % 3 == 0, F.lower(account)).otherwise(account).alias("routeid"),
            F.concat(F.lit(" T"), order % 40).alias("truckid"), F.when(order % 5 == 0, F.concat(F.lit("Truck "), order % 40)).alias("truckname"),
            F.col("l_linenumber").cast("string").alias("truckdroporder"), F.concat(F.lit("Stop "), "l_linenumber", F.lit(" ")).alias("dropinstructions"),
            F.when(F.col("l_tax") != 0, F.col("l_tax").cast("decimal(8,5)").cast("string")).alias("rate"))

    @cached_property
    def account_codes(self) -> DataFrame:
        return self.table("supplier").select(F.concat(F.lit("A"), zero_pad("s_suppkey", 6)).alias("code"), F.col("s_suppkey").alias("id"))

    @cached_property
    def publication_codes(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("code"), F.col("p_partkey").alias("id"))

    @cached_property
    def load(self) -> DataFrame:
        from pressroute.plans.imports import normalise_load
        return normalise_load(self.load_raw)

    @cached_property
    def load_base(self) -> DataFrame:
        """The table before the load: lacks some keys of the file and holds others the file lacks."""
        return self.draw_lines.where("line_no % 5 <> 0").groupBy(*DRAW_KEY).agg(
            F.sum("draw_amount").alias("draw_amount"), F.max("draw_rate").alias("draw_rate"))
