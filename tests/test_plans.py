"""Properties of the plans that results alone do not show."""

from datetime import date

import pytest

from chronaudit import Calendar, TableSpec, bindings, missing_dates, null_id_dates

FOLDER = "/root/testdata/sf0.001"
QUERIES = bindings.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_and_no_python(spark, name):
    """The readers of sorted ranges are the one place for Python; they take Arrow batches."""
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "ExistingRDD"):
        assert node not in plan


@pytest.fixture(scope="module")
def spec(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    return TableSpec("orders", orders, "o_orderdate", "o_orderpriority", "o_orderkey")


def test_missing_dates_shuffle_the_table_once(spark, spec):
    plan = plan_of(missing_dates(spec, Calendar(spark, date(1995, 1, 1), date(2001, 12, 31)), date(2001, 8, 3)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_null_test_reaches_the_scan(spark, spec):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(null_id_dates(spec, Calendar.for_year(spark, 1997), date(2001, 8, 3)))
    assert "IsNull(o_orderkey)" in plan


@pytest.mark.parametrize("name", ["f03_in_list", "s01_named_queries"])
def test_text_filters_reach_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "GreaterThanOrEqual(c_mktsegment" in plan or "GreaterThanOrEqual" in plan.split("PushedFilters")[1]
