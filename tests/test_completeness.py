import random
from datetime import date, timedelta

import pytest
from helpers import dates, day, frame, rows

from chronaudit import (
    Calendar,
    TableSpec,
    date_coverage,
    date_flags,
    missing_dates,
    missing_dates_any,
    missing_month_ends,
    missing_months,
    null_id_dates,
    stale_weekly,
)

SCHEMA = "pid string, rdate date, secid string"


def weekdays(start, end):
    d = day(start)
    while d <= day(end):
        if d.weekday() < 5:
            yield d
        d += timedelta(days=1)


def spec(df, frequency="daily"):
    return TableSpec("holding", df, "rdate", "pid", "secid", frequency)


@pytest.fixture(scope="module")
def cal(spark):
    off = frame(spark, "holiday_date date", [("2021-01-18",), ("2021-01-18",), (None,)])
    return Calendar.for_year(spark, 2021, off)


def test_missing_dates_per_group(spark, cal):
    full = [("full", d, "x") for d in weekdays("2021-01-01", "2021-02-05")]
    gap = [("gap", d, "x") for d in weekdays("2021-01-01", "2021-02-05") if d != date(2021, 1, 11)]
    odd = [("odd", "2021-01-18", "x"), ("odd", "2021-01-30", "x")]  # a holiday and a Saturday
    nobody = [(None, "2021-01-04", "x"), ("undated", None, "x"), ("last year", "2020-06-01", "x")]
    table = frame(spark, SCHEMA, full + gap + odd + nobody)
    # As of Friday 5 February the cutoff is Thursday: Wednesday is the last day due.
    found = missing_dates(spec(table), cal, date(2021, 2, 5))
    by_group = {}
    for r in found.collect():
        by_group.setdefault(r["pid"], []).append(r["rdate"])
    due = [d for d in weekdays("2021-01-01", "2021-02-03") if d != date(2021, 1, 18)]
    assert by_group.keys() == {"gap", "odd"}
    assert by_group["gap"] == [date(2021, 1, 11)]
    assert sorted(by_group["odd"]) == due


def test_cutoff_excludes_yesterday(spark, cal):
    table = frame(spark, SCHEMA, [("a", "2021-01-01", "x")])
    assert dates(missing_dates(spec(table), cal, day("2021-01-07"))) == ["2021-01-04", "2021-01-05"]
    assert dates(missing_dates(spec(table), cal, day("2021-01-07"), lag_days=0)) == [
        "2021-01-04", "2021-01-05", "2021-01-06"
    ]
    assert missing_dates(spec(table), cal, day("2021-01-01")).count() == 0


def test_listed_groups_must_be_there(spark, cal):
    table = frame(spark, SCHEMA, [("a", "2021-01-04", "x")])
    listed = frame(spark, "pid string", [("a",), ("absent",), ("absent",), (None,)])
    found = missing_dates(spec(table), cal, day("2021-01-06"), groups=listed)
    assert rows(found) == [
        ("a", date(2021, 1, 1)), ("absent", date(2021, 1, 1)), ("absent", date(2021, 1, 4)),
    ]


def test_within_span_bounds_the_result(spark):
    two_years = Calendar(spark, date(2020, 1, 1), date(2021, 12, 31))
    table = frame(spark, SCHEMA, [("a", "2020-12-30", "x"), ("a", "2021-01-05", "x")])
    found = missing_dates(spec(table), two_years, day("2021-03-01"), within_span=True)
    assert dates(found) == ["2020-12-31", "2021-01-01", "2021-01-04"]


def test_years_equal_single_year_runs(spark):
    rng = random.Random(7)
    start = date(2019, 1, 1)
    table = frame(
        spark, SCHEMA,
        [(rng.choice("abc"), start + timedelta(days=rng.randrange(1096)), "x") for _ in range(900)],
    )
    whole = Calendar(spark, date(2019, 1, 1), date(2021, 12, 31))
    together = rows(missing_dates(spec(table), whole, day("2022-06-01")))
    apart = []
    for year in (2019, 2020, 2021):
        apart += rows(missing_dates(spec(table), Calendar.for_year(spark, year), day("2022-06-01")))
    assert together == sorted(apart)
    # What is missing and what is present make up what is expected.
    present = {(r["pid"], r["rdate"]) for r in table.collect() if r["rdate"].weekday() < 5}
    expected = {(g, d) for g in "abc" for d in weekdays("2019-01-01", "2021-12-31")}
    assert set(together) | present == expected and not set(together) & present


def test_month_ends_are_calendar_days(spark, cal):
    # 31 January 2021 is a Sunday and must be there; the Friday before does not count.
    table = frame(spark, SCHEMA, [("a", "2021-01-29", "x"), ("a", "2021-02-28", "x"), ("b", "2021-01-31", "x")])
    found = missing_month_ends(spec(table, "monthly"), cal, day("2021-04-02"))
    assert rows(found) == [("a", date(2021, 1, 31)), ("a", date(2021, 3, 31)),
                           ("b", date(2021, 2, 28)), ("b", date(2021, 3, 31))]
    # 31 March equals the cutoff on 1 April and is not yet due.
    assert missing_month_ends(spec(table, "monthly"), cal, day("2021-04-01")).count() == 2


def test_partition_by_year_gives_the_same(spark, cal, tmp_path):
    from chronaudit.sources.files import write_by_year

    table = frame(spark, SCHEMA, [("a", d, "x") for d in weekdays("2020-06-01", "2021-06-01")])
    write_by_year(table, str(tmp_path / "t"), "rdate")
    stored = TableSpec("holding", spark.read.parquet(str(tmp_path / "t")), "rdate", "pid", year_col="year")
    assert rows(missing_dates(stored, cal, day("2021-12-31"))) == rows(
        missing_dates(spec(table), cal, day("2021-12-31"))
    )
    plan = stored.between(cal.start, cal.end)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_whole_table_checks(spark, cal):
    table = frame(spark, "rdate date", [(d,) for d in weekdays("2021-01-01", "2021-11-30") if d.month != 3]
                  + [(None,), ("2020-12-01",)])
    missing = set(dates(missing_dates_any(table, "rdate", cal)))
    assert missing == {str(d) for m in ("03", "12") for d in weekdays(f"2021-{m}-01", f"2021-{m}-31")}
    months = dates(missing_months(table, "rdate", cal))
    assert len(months) == 62 and months[0] == "2021-03-01" and months[-1] == "2021-12-31"
    covered = {str(r["rdate"]): r["present"] for r in date_coverage(table, "rdate", cal).collect()}
    assert len(covered) == 364 and "2021-01-18" not in covered
    assert covered["2021-01-19"] and not covered["2021-01-16"] and not covered["2021-03-02"]


def test_empty_table_lacks_everything(spark, cal):
    nothing = frame(spark, "rdate date", [])
    assert missing_months(nothing, "rdate", cal).count() == 365
    assert missing_dates_any(nothing, "rdate", cal).count() == 260


def test_timestamps_count_by_day(spark, cal):
    table = spark.sql("SELECT 'a' AS pid, timestamp_ntz'2021-01-04 10:00:00' AS rdate, 'x' AS secid")
    assert "2021-01-04" not in dates(missing_dates(spec(table), cal, day("2021-01-08")))


def test_null_id_dates(spark, cal):
    table = frame(spark, SCHEMA, [
        ("a", "2021-01-04", None), ("a", "2021-01-04", None), ("a", "2021-01-05", "x"),
        ("b", "2021-01-09", None),  # a Saturday
        ("c", "2021-01-18", None),  # a holiday
        ("d", "2021-02-04", None),  # the cutoff itself
        (None, "2021-01-04", None),
    ])
    for frequency in ("daily", "monthly"):
        found = null_id_dates(spec(table, frequency), cal, day("2021-02-05"))
        assert rows(found) == [("a", date(2021, 1, 4))]


def test_date_flags_leave_out_the_end(spark):
    table = frame(spark, "rdate date", [("2021-10-27",), ("2021-10-27",), ("2021-10-29",), (None,)])
    found = date_flags(table, "rdate", day("2021-10-26"), day("2021-10-29"))
    assert rows(found) == [(date(2021, 10, 26), 0), (date(2021, 10, 27), 1), (date(2021, 10, 28), 0)]


@pytest.mark.parametrize(
    "as_of, due",
    # The cutoff is the day before; a Sunday that is itself the cutoff does not count.
    [("2021-11-09", "2021-11-07"), ("2021-11-08", "2021-10-31"), ("2021-11-07", "2021-10-31")],
)
def test_stale_weekly(spark, as_of, due):
    table = frame(spark, "name string, mdate date", [
        ("old", "2021-10-01"), ("old", "2021-10-30"), ("on time", "2021-11-07"), ("just", "2021-10-31"),
    ])
    found = {r["name"]: str(r["due"]) for r in stale_weekly(table, "name", "mdate", day(as_of)).collect()}
    expected = {"old"} | ({"just"} if due == "2021-11-07" else set())
    assert found == dict.fromkeys(expected, due)
