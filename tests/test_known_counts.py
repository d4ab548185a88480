"""Counts on the sf0.01 tables that were established independently of this package."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from chronaudit import (
    Calendar,
    TableSpec,
    irregular_gaps,
    missing_dates,
    missing_dates_any,
    missing_month_ends,
    missing_months,
    null_id_dates,
    orphan_ids,
    orphan_rows,
    stale_weekly,
    unmatched_events,
)
from chronaudit.bindings.fixtures import orders_with_lines

FOLDER = "/root/testdata/sf0.01"
LATER = date(2002, 1, 5)


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{FOLDER}/orders.parquet")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def test_one_year(spark, orders):
    cal = Calendar.for_year(spark, 1997)
    spec = TableSpec("orders", orders, "o_orderdate", "o_orderpriority")
    assert missing_dates(spec, cal, LATER).count() == 362
    assert missing_month_ends(spec, cal, LATER).count() == 16
    assert missing_dates_any(orders.where("o_orderstatus = 'F'"), "o_orderdate", cal).count() == 45
    assert missing_months(orders, "o_orderdate", Calendar.for_year(spark, 2001)).count() == 122


def test_whole_span(spark, orders, lines):
    cal = Calendar(spark, date(1995, 1, 1), date(2001, 12, 31))
    held = TableSpec("held", orders_with_lines(spark, FOLDER), "o_orderdate", "o_orderpriority", "l_orderkey")
    assert null_id_dates(held, cal, LATER).count() == 182
    assert orphan_ids(orders, lines, "o_orderkey", "l_orderkey").count() == 257
    assert orphan_rows(orders, lines, "o_orderkey", "l_orderkey").count() == 257
    finished = orders.where("o_orderstatus = 'F'")
    assert unmatched_events(finished, lines, ["o_orderkey"], ["l_orderkey"]).count() == 74
    assert stale_weekly(orders, "o_custkey", "o_orderdate", date(2001, 8, 3)).count() == 1477


def test_gaps(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    days = events.select("user_id", F.to_date("ts").alias("rdate")).distinct()
    assert irregular_gaps(days, "user_id", "rdate").count() == 413
