from datetime import date

import pytest
from pyspark.sql import functions as F

from chronaudit.functions import dates as fd


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "start, end, count",
    [("2021-01-01", "2021-01-03", 3), ("2021-01-01", "2021-01-01", 1), ("2021-01-02", "2021-01-01", 0)],
)
def test_days_between(spark, start, end, count):
    got = one(spark, fd.days_between(F.lit(date.fromisoformat(start)), F.lit(date.fromisoformat(end))))
    assert len(got) == count


@pytest.mark.parametrize(
    "start, end, ends",
    [
        ("2020-01-15", "2020-03-31", ["2020-01-31", "2020-02-29", "2020-03-31"]),
        ("2021-01-31", "2021-02-27", ["2021-01-31"]),
        ("2021-02-10", "2021-02-11", []),
        ("2021-05-10", "2021-02-11", []),
    ],
)
def test_month_ends_between(spark, start, end, ends):
    got = one(spark, fd.month_ends_between(F.lit(date.fromisoformat(start)), F.lit(date.fromisoformat(end))))
    assert [str(d) for d in got] == ends


@pytest.mark.parametrize(
    "day, label, name, week",
    [
        ("2021-08-01", "Su", "August", 1), ("2021-08-30", "M", "August", 6), ("2021-02-01", "M", "February", 1),
        ("2021-02-28", "Su", "February", 4), ("2020-02-29", "S", "February", 5),
    ],
)
def test_labels(spark, day, label, name, week):
    d = F.lit(date.fromisoformat(day))
    assert one(spark, fd.weekday_label(d)) == label
    assert one(spark, fd.month_name(d)) == name
    assert one(spark, fd.week_of_month(d)) == week
