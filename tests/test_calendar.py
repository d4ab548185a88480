from datetime import date, timedelta

import pytest
from helpers import dates, frame, rows

from chronaudit import Calendar, business_calendar, calendar_spanning, holidays, month_grid

HOLIDAYS = [
    ("NYS", "2021-01-01", "New Year"),
    ("TSE", "2021-01-01", "New Year"),
    ("NYS", "2021-07-04", "Independence Day"),
    ("TSE", "2021-07-01", "Canada Day"),
    (None, "2021-11-11", "unlisted"),
    ("NYS", "2020-12-25", "Christmas"),
]


@pytest.fixture(scope="module")
def listed(spark):
    return frame(spark, "fref_exchange_code string, holiday_date date, holiday_name string", HOLIDAYS)


def test_days_follow_the_calendar(spark, listed):
    cal = {r["date"]: r for r in Calendar.for_year(spark, 2021, listed).days().collect()}
    assert len(cal) == 365
    for d, r in cal.items():
        first = d.replace(day=1)
        assert (r["year"], r["month"], r["day"]) == (d.year, d.month, d.day)
        assert r["weekday"] == d.weekday()
        assert r["week"] == -(-(d.day + first.weekday()) // 7)
        assert r["bday"] == (d.weekday() < 5 and r["holiday_flag"] == 0)
    # Both exchanges on one day count once; a holiday on a Sunday changes nothing.
    assert cal[date(2021, 1, 1)]["holiday_flag"] == 1
    assert cal[date(2021, 7, 4)]["holiday_flag"] == 1 and not cal[date(2021, 7, 4)]["bday"]
    assert sum(r["holiday_flag"] for r in cal.values()) == 4


def test_leap_year_and_week_counts(spark):
    cal = business_calendar(spark, date(2020, 1, 1), date(2020, 12, 31))
    assert cal.count() == 366
    # August 2021 starts on a Sunday (6 weeks), February 2021 on a Monday (4 weeks).
    weeks = {r["month"]: r["w"] for r in
             Calendar.for_year(spark, 2021).days().groupBy("month").agg({"week": "max"}).toDF("month", "w").collect()}
    assert weeks[8] == 6 and weeks[2] == 4


def test_spanning_follows_the_table(spark, listed):
    table = frame(spark, "rdate date", [("2021-01-05",), ("2020-12-24",), (None,)])
    cal = calendar_spanning(table, "rdate", listed)
    found = {r["date"]: r["holiday_flag"] for r in cal.collect()}
    assert sorted(found) == [date(2020, 12, 24) + timedelta(days=i) for i in range(13)]
    assert {d for d, f in found.items() if f} == {date(2020, 12, 25), date(2021, 1, 1)}
    assert calendar_spanning(table.where("rdate is null"), "rdate").count() == 0


def test_reversed_calendar_is_refused(spark):
    with pytest.raises(ValueError):
        Calendar(spark, date(2021, 1, 2), date(2021, 1, 1))


@pytest.mark.parametrize(
    "us, ca, mode, expected",
    [
        # Latest: TSE only on request, the US switch changes nothing, null codes stay.
        (True, True, "latest", ["2021-01-01", "2021-07-01", "2021-07-04", "2021-11-11"]),
        (False, False, "latest", ["2021-01-01", "2021-07-04", "2021-11-11"]),
        (True, False, "latest", ["2021-01-01", "2021-07-04", "2021-11-11"]),
        (True, True, "flags", ["2021-01-01", "2021-07-01", "2021-07-04", "2021-11-11"]),
        (True, False, "flags", ["2021-01-01", "2021-07-04"]),
        (False, True, "flags", ["2021-01-01", "2021-07-01"]),
        (False, False, "flags", []),
    ],
)
def test_holiday_switches(listed, us, ca, mode, expected):
    assert dates(holidays(listed, us, ca, 2021, mode), "holiday_date") == expected


def test_month_grid_of_days(spark):
    grid = month_grid(Calendar.for_year(spark, 2021).days().where("month = 8"))
    assert rows(grid)[0] == (2021, 8, 1, "", "", "", "", "", "", "1")
    assert rows(grid)[-1] == (2021, 8, 6, "30", "31", "", "", "", "", "")
    working = month_grid(Calendar.for_year(spark, 2021).days().where("month = 8"), working_week=True)
    assert working.columns == ["year", "month", "week", "M", "T", "W", "Th", "F"]
