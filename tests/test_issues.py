"""The issue table, its reports and the status views."""

from dataclasses import replace
from datetime import date

import pytest
from helpers import day, frame, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronaudit import (
    Calendar,
    EventRule,
    TableSpec,
    bad_dates,
    date_verdict,
    day_reason,
    day_status,
    iso_week_grid,
    issue_detail,
    issue_summary,
    issues_on_date,
    join_by_date,
    keep_issues,
    run_checks,
    status_codes,
    status_matrix,
    year_month_status,
)
from chronaudit.model import (
    BAD_ROW,
    ISSUE_SCHEMA,
    NO_DATA,
    NO_FLAG,
    NO_ID,
    NO_REFERENCE,
    NOT_DAILY,
    NOT_MONTHLY,
    ORPHAN_ROW,
    SIZE_JUMP,
)
from chronaudit.operators.status import MATRIX_CHECKS, REASON_ORDER


def issue_table(spark, *issues):
    """Issues as (table, type, group, date, entity, metric); trailing parts may be left out."""
    filled = [tuple(i) + (None,) * (6 - len(i)) for i in issues]
    fixed = [(t, k, g, day(d) if d else None, e, m) for t, k, g, d, e, m in filled]
    return spark.createDataFrame(fixed, ISSUE_SCHEMA)


def test_summary_counts_dates_once(spark):
    issues = issue_table(
        spark,
        ("h", NO_DATA, "a", "2021-01-04"), ("h", NO_DATA, "b", "2021-01-04"), ("h", NO_DATA, "b", "2021-01-05"),
        ("h", NO_ID, "a", "2021-01-04"),
        ("u", NO_REFERENCE, None, None, "x"), ("u", NO_REFERENCE, None, None, None),
        ("u", SIZE_JUMP, "US", "2021-01-31", None, 0.2), ("u", SIZE_JUMP, "CANADA", "2021-01-31", None, 0.3),
        ("d", NO_FLAG, "k", "2021-01-01"), ("d", NO_FLAG, "k", "2021-02-01"), ("d", NO_FLAG, "k", "2021-03-01"),
        ("other", NO_DATA, "a", "2021-01-04"),
    )
    assert rows(issue_summary(issues, ["h", "u", "d", "clean"])) == [
        ("clean", 0, 0, 0, 0, 0, 0),
        ("d", 1, 0, 0, 0, 0, 1),
        ("h", 3, 2, 1, 0, 0, 0),
        ("u", 4, 0, 0, 2, 2, 0),
    ]


def test_detail_has_a_column_per_group(spark):
    issues = issue_table(
        spark,
        ("u", NO_DATA, "US", "2021-01-31"), ("u", NO_DATA, "CANADA", "2021-01-31"),
        ("u", SIZE_JUMP, "US", "2021-02-28", None, 0.25), ("u", NO_REFERENCE, None, None, "x"),
        ("h", NO_DATA, "US", "2021-03-31"),
    )
    assert rows(issue_detail(issues, "u", ["US", "CANADA"])) == [
        (NO_REFERENCE, None, "x", None, None),
        (NO_DATA, "2021-01-31", None, 1.0, 1.0),
        (SIZE_JUMP, "2021-02-28", None, 0.25, None),
    ]


def test_detail_does_not_lose_unlisted_groups(spark):
    issues = issue_table(
        spark, ("u", SIZE_JUMP, "US", "2021-02-28", None, 0.25), ("u", SIZE_JUMP, "JAPAN", "2021-02-28", None, 0.5),
        ("u", NO_REFERENCE, None, None, "x"),
    )
    with pytest.raises(PySparkException, match="JAPAN"):
        issue_detail(issues, "u", ["US"]).collect()
    assert rows(issue_detail(issues, "u", ["US"], others=True)) == [
        (NO_REFERENCE, None, "x", None, None, None),
        (SIZE_JUMP, "2021-02-28", None, None, "JAPAN", 0.5), (SIZE_JUMP, "2021-02-28", None, 0.25, None, None),
    ]


@pytest.fixture(scope="module")
def june(spark):
    return issue_table(
        spark,
        ("bmprices", NOT_DAILY, None, "2021-06-09"), ("bmprices", NOT_DAILY, None, "2021-06-10"),
        ("portholding", BAD_ROW, "a", "2021-06-01"), ("portholding", BAD_ROW, "a", "2021-06-09"),
        ("bmc_monthly", NOT_MONTHLY, None, "2021-06-30"), ("bmc_monthly", BAD_ROW, "b", "2021-06-02"),
        ("univsnapshot", ORPHAN_ROW, "US", "2021-06-30", "x"), ("univsnapshot", ORPHAN_ROW, "US", "2021-05-31", "y"),
    )


def test_issues_on_date(june):
    found = issues_on_date(june, day("2021-06-09"))
    assert len(rows(found)) == 6
    exact = issues_on_date(june, day("2021-06-09"), [("portholding", BAD_ROW)])
    assert [str(r["rdate"]) for r in exact.where("table_name = 'portholding'").collect()] == ["2021-06-09"]
    assert rows(issues_on_date(june, day("2020-06-09"))) == []


def test_verdicts(june):
    tables = ["bmprices", "portholding", "bmc_monthly", "univsnapshot", "portreturn"]
    assert dict(rows(date_verdict(june, day("2021-06-09"), tables))) == {
        "bmprices": "no data", "portholding": "problematic rows", "bmc_monthly": "no data",
        "univsnapshot": "problematic rows", "portreturn": "success",
    }
    both = date_verdict(june, day("2021-06-09"), ["bmc_monthly", "portreturn"], show_all=True)
    assert rows(both) == [
        ("bmc_monthly", "no data"), ("bmc_monthly", "problematic rows"), ("portreturn", "success"),
    ]


def test_monthly_tables_concern_the_month(spark):
    issues = issue_table(spark, ("m", NO_DATA, "a", "2021-06-30"), ("d", NO_DATA, "a", "2021-06-30"))
    assert rows(date_verdict(issues, day("2021-06-09"), ["m", "d"], monthly=["m"])) == [
        ("d", "success"), ("m", "no data"),
    ]
    assert rows(issues_on_date(issues, day("2021-07-01"), monthly=["m"])) == []
    cal = Calendar(spark, date(2021, 6, 30), date(2021, 6, 30))
    assert rows(status_codes(cal.days(), issues, ["m", "d"], ["m"])) == [(date(2021, 6, 30), 2, 1, 0)]


def test_kept_issues_are_the_same(spark, june):
    kept = keep_issues(june)
    assert kept.schema == ISSUE_SCHEMA and rows(kept) == rows(june)


def test_bad_dates(june):
    found = bad_dates(june, ["portholding", "bmprices"])
    assert [str(r[0]) for r in rows(found)] == ["2021-06-01", "2021-06-09", "2021-06-10"]
    assert rows(bad_dates(june, ["nothing"])) == []


def test_join_by_date(spark):
    a = frame(spark, "rdate date, n int, s string", [("2021-01-01", 1, "x"), ("2021-01-02", 2, None)])
    b = frame(spark, "rdate date, n int", [("2021-01-02", 5), ("2021-01-03", 6)])
    joined = join_by_date({"a": a, "b": b})
    assert joined.columns == ["rdate", "a_n", "a_s", "b_n"]
    assert rows(joined) == [
        (date(2021, 1, 1), 1, "x", None), (date(2021, 1, 2), 2, None, 5), (date(2021, 1, 3), None, None, 6),
    ]
    with pytest.raises(PySparkException, match="occurs twice"):
        join_by_date({"a": a.union(a), "b": b}).collect()


def test_join_by_date_keeps_repeats_and_undated_rows(spark):
    a = frame(spark, "rdate date, n int", [("2021-01-01", 2), ("2021-01-01", 1), (None, 3)])
    b = frame(spark, "rdate date, n int", [("2021-01-01", 5), (None, 6)])
    assert rows(join_by_date({"a": a, "b": b}, repeats=True)) == rows_like([
        (date(2021, 1, 1), 1, 1, 5), (date(2021, 1, 1), 2, 2, None), (None, 1, 3, None), (None, 1, None, 6),
    ])
    dated = a.where("n != 1")
    assert rows(join_by_date({"a": dated, "b": b})) == rows_like([(date(2021, 1, 1), 2, 5), (None, 3, None), (None, None, 6)])


def rows_like(values):
    return sorted(values, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_day_status_takes_the_highest(spark):
    off = frame(spark, "holiday_date date", [("2021-06-08",), ("2021-06-10",), ("2021-06-12",), ("2021-06-15",)])
    cal = Calendar(spark, date(2021, 5, 31), date(2021, 7, 1), off)
    issues = issue_table(
        spark, ("t", NO_DATA, "a", "2021-06-05"), ("t", NO_DATA, "a", "2021-06-08"),
        ("t", NO_DATA, "a", "2021-06-16"), ("t", NO_DATA, "a", "2021-06-10"), ("other", NO_DATA, "a", "2021-06-01"),
        ("t", NO_REFERENCE, None, None, "x"),
    )
    found = {str(d): s for _, d, s in rows(day_status(cal.days(), issues, ["t"], day("2021-06-10")))}
    expected = {
        "2021-06-01": "none", "2021-06-05": "quality issue", "2021-06-08": "quality issue",
        "2021-06-06": "weekend", "2021-06-12": "weekend", "2021-06-10": "quality issue",
        "2021-06-15": "holiday", "2021-06-11": "later", "2021-06-16": "quality issue",
        "2021-07-01": "none", "2021-05-31": "none",
    }
    assert {d: found[d] for d in expected} == expected
    clean = {str(d): s for _, d, s in rows(day_status(cal.days(), issues, ["u"], day("2021-06-09")))}
    assert clean["2021-06-09"] == "today"
    assert {str(d): s for _, d, s in rows(day_status(cal.days(), issues, ["u"], day("2021-06-10")))}[
        "2021-06-10"] == "holiday"


def test_matrix_and_reason_precedence(spark):
    """With checks failing from the i-th on, the i-th is the reason."""
    start = date(2021, 3, 1)
    issues, expected = [], {}
    for i in range(len(REASON_ORDER)):
        d = date(2021, 3, 1 + i)
        expected[d] = REASON_ORDER[i]
        for check in REASON_ORDER[i:]:
            table, kind = MATRIX_CHECKS[check]
            issues.append((table, kind, None, str(d)))
    off = frame(spark, "holiday_date date", [("2021-03-20",), ("2021-03-25",)])
    cal = Calendar(spark, start, date(2021, 3, 31), off)
    issues += [("bmprices", NOT_DAILY, None, d) for d in ("2021-03-20", "2021-03-24", "2021-03-26")]
    matrix = status_matrix(cal.days(), issue_table(spark, *issues))
    assert matrix.columns == ["rdate", *MATRIX_CHECKS, "holiday"]
    assert matrix.where("rdate = date'2021-03-01'").first().asDict() == {
        "rdate": start, **dict.fromkeys(MATRIX_CHECKS, True), "holiday": False
    }
    reasons = {r["rdate"]: r["reason"] for r in day_reason(matrix, day("2021-03-24")).collect()}
    assert {d: reasons[d] for d in expected} == expected
    assert reasons[date(2021, 3, 20)] == "holiday"
    assert reasons[date(2021, 3, 24)] == "today"
    assert reasons[date(2021, 3, 25)] == "none" and reasons[date(2021, 3, 26)] == "none"
    assert reasons[date(2021, 3, 22)] == "none"


@pytest.mark.parametrize(
    "kinds, code",
    [
        ([], 0), ([NOT_DAILY], 1), ([NOT_MONTHLY], 2), ([BAD_ROW], 3), ([SIZE_JUMP], 3), ([ORPHAN_ROW], 4),
        ([BAD_ROW, NOT_MONTHLY], 2), ([NOT_MONTHLY, ORPHAN_ROW], 4), ([SIZE_JUMP, ORPHAN_ROW], 4),
        ([BAD_ROW, NOT_DAILY], 1), ([BAD_ROW, NOT_MONTHLY, ORPHAN_ROW, SIZE_JUMP], 4),
    ],
)
def test_status_codes(spark, kinds, code):
    off = frame(spark, "holiday_date date", [("2021-03-02",)])
    cal = Calendar(spark, date(2021, 3, 1), date(2021, 3, 2), off)
    issues = issue_table(spark, *[("t", k, None, "2021-03-01") for k in kinds])
    assert rows(status_codes(cal.days(), issues, ["t", "u"])) == [
        (date(2021, 3, 1), code, 0, 0), (date(2021, 3, 2), 0, 0, 5),
    ]


def test_iso_week_grid(spark):
    table = frame(spark, "d date, v double", [
        ("2015-03-13", 1.0), ("2015-03-16", 2.0), ("2015-03-16", 3.0), ("2015-03-22", 4.0), (None, 9.0),
    ])
    assert rows(iso_week_grid(table, "d", "v")) == [
        (0, None, None, None, None, 1.0, None, None), (1, 3.0, None, None, None, None, None, 4.0),
    ]


def test_iso_weeks_of_several_years_stay_apart(spark):
    table = frame(spark, "d date, v int", [("2020-12-30", 1), ("2021-12-29", 2), ("2022-12-28", 3), ("2021-01-01", 4)])
    found = {r["week"]: [r[i] for i in range(1, 8)] for r in iso_week_grid(table, "d", "v").collect()}
    assert found == {0: [None, None, 1, None, 4, None, None], 52: [None, None, 2] + [None] * 4, 104: [None, None, 3] + [None] * 4}


def test_year_month_status(spark, june):
    grid = {r["year"]: r.asDict() for r in year_month_status(june, 2020, 2022).collect()}
    assert sorted(grid) == [2020, 2021, 2022]
    assert [m for m, hit in grid[2021].items() if hit is True] == ["May", "June"]
    assert not any(v is True for v in grid[2020].values())


# Audits


@pytest.fixture(scope="module")
def audited(spark):
    holding = frame(spark, "pid string, rdate date, secid string", [
        ("a", "2021-01-01", "x"), ("a", "2021-01-05", None), ("b", "2021-01-04", "x"), (None, "2021-01-04", None),
    ])
    universe = frame(spark, "univ_id string, rdate date, fsym_id string", [
        ("US", "2021-01-31", "x"), ("US", "2021-02-28", "x"), ("US", "2021-02-28", "new"), ("CA", "2021-01-31", None),
    ])
    history = frame(spark, "fsym_id string, exdate date, kind string, flag boolean", [
        ("k", "2019-01-01", "suspension", False), ("k", "2019-05-01", "regular", False),
        ("k", "2019-09-01", "regular", False),
    ])
    known = frame(spark, "fsym_id string", [("x",)])
    return [
        TableSpec("holding", holding, "rdate", "pid", "secid", "daily",
                  checks=(NO_DATA, NO_ID, NOT_DAILY, BAD_ROW)),
        TableSpec("universe", universe, "rdate", "univ_id", "fsym_id", "monthly",
                  checks=(NO_DATA, NO_REFERENCE, SIZE_JUMP, NOT_MONTHLY, ORPHAN_ROW),
                  reference=known, reference_key="fsym_id", change_tolerance=0),
        TableSpec("history", history, "exdate", "fsym_id", None, None, checks=(NO_FLAG,),
                  event_rule=EventRule("kind", "suspension", "flag")),
    ]


def test_specs_that_do_not_fit_are_errors(spark, audited):
    cal, at = Calendar.for_year(spark, 2021), day("2021-01-08")
    holding, _, history = audited
    with pytest.raises(ValueError, match="no table nowhere"):
        run_checks(audited, cal, at, selected=["universe", "nowhere"])
    with pytest.raises(ValueError, match="none of its checks"):
        run_checks(audited, cal, at, selected=["history"], style="table")
    for changed, said in (
        (replace(holding, id_col=None), "without id_col"), (replace(holding, group_col=None), "without group_col"),
        (replace(holding, frequency=None), "without frequency"), (replace(history, event_rule=None), "without event_rule"),
        (replace(holding, checks=(NO_REFERENCE,)), "without reference"),
    ):
        with pytest.raises(ValueError, match=said):
            run_checks([changed], cal, at)
    with pytest.raises(ValueError, match="grouped style"):
        run_checks(audited, cal, at, style="table", within_span=True)
    with pytest.raises(ValueError, match="groups: no table"):
        run_checks(audited, cal, at, groups={"nowhere": holding.df})


def test_audit_with_listed_groups_and_spans(spark, audited):
    cal, at = Calendar.for_year(spark, 2021), day("2021-01-08")
    listed = {"holding": frame(spark, "pid string", [("a",), ("z",)])}
    found = run_checks(audited, cal, at, selected=["holding"], groups=listed).where(F.col("issue_type") == NO_DATA)
    assert {r["group_value"] for r in found.collect()} == {"a", "b", "z"}
    assert found.where("group_value = 'z'").count() == 5 - 1  # the business days up to the sixth
    spans = run_checks(audited, cal, at, selected=["holding"], within_span=True).where(F.col("issue_type") == NO_DATA)
    assert rows(spans) == [("holding", NO_DATA, "a", day("2021-01-04"), None, None)]


def test_grouped_audit(spark, audited):
    found = run_checks(audited, Calendar.for_year(spark, 2021), day("2021-01-08"))
    assert found.schema.simpleString() == ISSUE_SCHEMA.simpleString()
    assert set(rows(found)) == {
        ("holding", NO_DATA, "a", day("2021-01-04"), None, None),
        ("holding", NO_DATA, "a", day("2021-01-06"), None, None),
        ("holding", NO_DATA, "b", day("2021-01-01"), None, None),
        ("holding", NO_DATA, "b", day("2021-01-05"), None, None),
        ("holding", NO_DATA, "b", day("2021-01-06"), None, None),
        ("holding", NO_ID, "a", day("2021-01-05"), None, None),
        ("universe", NO_REFERENCE, None, None, "new", None),
        ("universe", NO_REFERENCE, None, None, None, None),
        # Sizes are judged beyond the cutoff as well.
        ("universe", SIZE_JUMP, "US", day("2021-02-28"), None, 0.5),
        ("history", NO_FLAG, "k", day("2019-01-01"), "k", None),
        ("history", NO_FLAG, "k", day("2019-05-01"), "k", None),
    }
    summary = rows(issue_summary(found, [s.name for s in audited]))
    assert summary == [("history", 1, 0, 0, 0, 0, 1), ("holding", 5, 4, 1, 0, 0, 0), ("universe", 3, 0, 0, 2, 1, 0)]


def test_table_audit(spark, audited):
    cal = Calendar(spark, date(2021, 1, 1), date(2021, 3, 31))
    found = run_checks(audited, cal, day("2021-01-08"), style="table")
    counts = {(r["table_name"], r["issue_type"]): r["count"] for r in
              found.groupBy("table_name", "issue_type").count().collect()}
    assert counts == {
        ("holding", NOT_DAILY): 61, ("holding", BAD_ROW): 2, ("universe", NOT_MONTHLY): 31,
        ("universe", ORPHAN_ROW): 2, ("universe", SIZE_JUMP): 1,
    }


def test_selection_is_respected(spark, audited):
    cal = Calendar.for_year(spark, 2021)
    some = run_checks(audited, cal, day("2021-01-08"), selected=["universe"])
    assert {r["table_name"] for r in some.collect()} == {"universe"}
    none = run_checks(audited, cal, day("2021-01-08"), selected=[])
    assert none.count() == 0 and none.schema == ISSUE_SCHEMA
    with pytest.raises(ValueError):
        run_checks(audited, cal, day("2021-01-08"), style="other")


def test_spec_names_its_faults(spark):
    df = frame(spark, "pid string, rdate date", [])
    for wrong in (
        {"group_col": "nope"}, {"frequency": "weekly"}, {"checks": ("nope",)}, {"reference": df},
        {"reference": df, "reference_key": "nope"}, {"date_col": "nope"},
    ):
        with pytest.raises(ValueError):
            TableSpec("t", df, **wrong)
    with pytest.raises(ValueError):
        TableSpec("it's", df)
