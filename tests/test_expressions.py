"""Expressions are written out once in a plan, and the fixture's work is dealt over all cores."""

from pyspark.sql import functions as F

from kinweave.functions import dates, names
from kinweave.operators import localenames
from kinweave.plans import fixture
from kinweave.sources import gedcom


def rlikes(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


def test_a_date_is_read_once(spark):
    rows = spark.createDataFrame([("31 feb 2000",)], "v string").select(dates.parse(F.col("v")).alias("p"))
    assert rlikes(rows) == len(dates.MONTHS)
    assert tuple(rows.first()["p"]) == (2000, 2, None, 1, None)


def test_customers_are_dealt_over_all_cores(spark):
    rows = fixture.persons(spark, "/root/testdata/sf0.01")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_scripts_are_told_once(spark):
    rows = spark.createDataFrame([("Анна-Anna (חנה)",)], "v string")
    assert rlikes(rows.select(names.script(F.col("v")).alias("s"))) == len(names.SCRIPTS)
    none = [F.lit(None).cast("string").alias(c) for c in ("first", "middle", "last", "maiden", "suffix")]
    rows = rows.select(F.create_map(F.lit("en-US"), F.create_map(F.lit("first_name"), F.col("v"))).alias("names"), *none)
    out = localenames.fix(rows, ("ScriptSplit",))
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 30)
    assert rlikes(out) < 100
    assert out.first()["names"] == {"ru": {"first_name": "Анна"}, "he": {"first_name": "חנה"}, "en-US": {"first_name": "Anna"}}


def test_dates_of_files_and_updates_are_cut_once(spark):
    rows = spark.createDataFrame([("ABT 31 FEB 2000",)], "v string")
    cuts = lambda c: rows.select(c.alias("p"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")
    # nullif writes its value twice
    assert cuts(gedcom.date(F.col("v"))) == 10 and cuts(dates.update_form(F.col("v"))) == 4
    got = rows.select(gedcom.date(F.col("v")).alias("a"), dates.update_form(F.col("v")).alias("b")).first()
    assert tuple(got["a"]) == (2000, 2, None, 1) and tuple(got["b"]) == (31, 2, 2000)
