"""SQL functions, procedures, collated codes and the load view."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressroute.functions.sql_library import VIEWS, create_functions
from pressroute.operators import collation
from pressroute.plans import procedures
from pressroute.plans.load_view import STANDARD, Field, read_by, standard_fields, write_checked
from pressroute.session import shared_folder
from pressroute.sources.frames import Frames

BASE = "/root/testdata/sf0.001"


@pytest.fixture()
def functions(spark):
    t = Frames(spark, BASE)
    create_functions(spark, {name: getattr(t, name) for name in VIEWS})
    return spark


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_arguments_reach_the_scan(functions):
    text = plan(functions.sql("SELECT * FROM manifest_list(acct_code => 'Supplier#000000003')"))
    assert "EqualTo(s_name,Supplier#000000003)" in text and "Python" not in text
    assert "IsNotNull(s_name)" not in plan(functions.sql("SELECT * FROM manifest_list()"))  # an argument left out is no filter


def test_scalar_functions_and_defaults(functions):
    row = functions.sql("SELECT day_list(65) AS d, day_list(0) AS none, scrub_phone('(800) 555-1.2') AS p, day_list(NULL) AS n").first()
    assert (row.d, row.none, row.p, row.n) == ("SUN, SAT", "", "800 55512", None)
    assert [tuple(r) for r in functions.sql("SELECT * FROM split_text('a,b.c')").collect()] == [(1, "a"), (2, "b.c")]
    assert [r.item for r in functions.sql("SELECT * FROM split_text(separator => '.', content => 'a,b.c')").collect()] == ["a,b", "c"]
    with pytest.raises(ValueError, match="accounts"):
        create_functions(functions, {})


def test_a_procedure_replaces_its_last_result(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    select = "SELECT id, 'it''s' AS note FROM numbers WHERE id < ?"
    for most in (4, 2):
        got = procedures.run_procedure(spark, "few_numbers", select, {"most": ("INT", most)})
        assert sorted(r.id for r in got.collect()) == list(range(most))
    assert len(spark.catalog.listTables(pattern="few_numbers_run_*")) == 1
    with pytest.raises(Exception):
        procedures.run_procedure(spark, "few_numbers", "SELECT id / 0 AS id, 'x' AS note FROM numbers WHERE id < ?", {"most": ("INT", 9)})
    assert spark.table("few_numbers").count() == 2


def test_codes_meet_without_case_and_trailing_blanks(spark):
    left = collation.as_codes(spark.createDataFrame([("Ab  ", 1), ("ab", 2), (" ab", 3), (None, 4)], "code string, v int"), "code")
    right = collation.as_codes(spark.createDataFrame([("AB", 7)], "code string, w int"), "code")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "code")
        text = plan(joined)
        assert sorted(r.v for r in joined.collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [collationkey(" in text and "NestedLoop" not in text
    grouped = collation.plain(left.groupBy("code").agg(F.sum("v").alias("v")), "code")
    assert plan(grouped).count("Exchange") == 1
    assert sorted(map(tuple, grouped.collect()), key=repr) == sorted([("ab", 3), (" ab", 3), (None, 4)], key=repr)
    assert left.select("code").distinct().count() == 3
    row = spark.createDataFrame([("xAy",)], "s string").select(collation.replace_text("s", "a", "-").alias("r"), collation.like_code("s", "X%").alias("l")).first()
    assert (row.r, row.l) == ("x-y", True)


def test_load_view_reads_defaults_codes_and_faults(spark):
    raw = spark.createDataFrame([
        (1, " a1 ", "05", None, "01/31/2024"), (2, "A2", "x", "", "02/30/2024"), (3, "zz", None, "Main", "  "), (4, None, " 7 ", "M" * 30, "12/01/2024")],
        "row int, acct string, amount string, name string, day string")
    codes = spark.createDataFrame([("A1", 11), ("a2 ", 12)], "code string, id long")
    fields = [Field("acctcode", ("acct",), codes="accounts", required=True), Field("drawamount", ("amount",), 0, "int"),
              Field("mfstname", ("name", "acct"), "none", longest=20), Field("drawdate", ("day",), None, "date", "MM/dd/yyyy"), Field("accttype", default="UNKN")]
    view = read_by(raw, fields, {"accounts": codes}, keep=["row"])
    got = {r.row: tuple(r)[1:] for r in view.collect()}
    assert got[1] == ("a1", 11, 5, "a1", dt.date(2024, 1, 31), "UNKN", [])
    assert got[2] == ("A2", 12, None, "A2", None, "UNKN", ["drawamount: cannot read x", "drawdate: cannot read 02/30/2024"])
    assert got[3] == ("zz", None, 0, "Main", None, "UNKN", ["acctcode: unknown code zz"])
    assert got[4] == ("", None, 7, "M" * 30, dt.date(2024, 12, 1), "UNKN", ["acctcode: missing", "mfstname: longer than 20"])
    good, bad = write_checked(view, shared_folder(spark, "load-view"))
    assert [r.row for r in good.collect()] == [1] and sorted(r.row for r in bad.collect()) == [2, 3, 4]
    assert "faults" not in good.columns and bad.columns[-1] == "faults"


def test_the_standard_view_has_all_columns():
    fields = standard_fields({"acctcode": Field("acctcode", ("code",))})
    assert [f.name for f in fields] == list(STANDARD) and len(fields) == 57
    assert {f.kind for f in fields if f.name.endswith("date")} == {"date"}
    with pytest.raises(ValueError, match="acctcod"):
        standard_fields({"acctcod": Field("acctcod")})
