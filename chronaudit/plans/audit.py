"""Run the checks that apply to each table and collect their findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame

from chronaudit.model import (
    BAD_ROW,
    GROUPED_CHECKS,
    ISSUE_SCHEMA,
    NO_DATA,
    NO_FLAG,
    NO_ID,
    NO_REFERENCE,
    NOT_DAILY,
    NOT_MONTHLY,
    ORPHAN_ROW,
    SIZE_JUMP,
    TABLE_CHECKS,
    TableSpec,
    as_issues,
)
from chronaudit.operators.calendar import Calendar
from chronaudit.operators.completeness import missing_dates, missing_dates_any, missing_month_ends, missing_months
from chronaudit.operators.events import missing_flag_after_event
from chronaudit.operators.integrity import null_rows, orphan_ids, orphan_rows
from chronaudit.operators.issues import no_issues
from chronaudit.operators.rollup import expected_by_year, profile
from chronaudit.operators.size import group_change_abs
from chronaudit.sources.files import scratch_path


def _fit(spec: TableSpec, style: str, named: bool) -> set[str]:
    """The checks of a table that the style runs; an error where they lack what they need."""
    checks = set(spec.checks) & set(GROUPED_CHECKS if style == "grouped" else TABLE_CHECKS)
    if named and not checks:
        raise ValueError(f"{spec.name}: none of its checks {sorted(spec.checks)} is of the {style} style")
    needs = {
        "id_col": {NO_ID, NO_REFERENCE, BAD_ROW, ORPHAN_ROW},
        "reference": {NO_REFERENCE, ORPHAN_ROW},
        "event_rule": {NO_FLAG},
        "group_col": {NO_DATA, NO_ID, SIZE_JUMP, NO_FLAG},
        "frequency": {NO_DATA},
    }
    for part, users in needs.items():
        lacking = sorted(checks & users)
        if lacking and getattr(spec, part) is None:
            raise ValueError(f"{spec.name}: {', '.join(lacking)} without {part}")
    return checks


def _grouped_findings(
    spec: TableSpec, calendar: Calendar, expected: DataFrame, checks: set[str], as_of: date, lag_days: int,
    groups: DataFrame | None, within_span: bool,
):
    profiled = checks & {NO_DATA, NO_ID, SIZE_JUMP}
    if NO_DATA in checks and (groups is not None or within_span):
        profiled -= {NO_DATA}
        absent = missing_month_ends if spec.frequency == "monthly" else missing_dates
        found = absent(spec, calendar, as_of, lag_days, groups, within_span)
        yield as_issues(found, spec.name, NO_DATA, spec.group_col, "rdate")
    if profiled:
        found = profile(spec, calendar, expected, profiled)
        yield as_issues(found, spec.name, None, "group_value", "rdate", None, "metric")
    if NO_REFERENCE in checks:
        rows = spec.between(calendar.start, calendar.end)
        found = orphan_ids(rows, spec.reference, spec.id_col, spec.reference_key)
        yield as_issues(found, spec.name, NO_REFERENCE, entity=spec.id_col)
    if NO_FLAG in checks:
        # Events are judged over their whole history, whatever the calendar.
        rule = spec.event_rule
        found = missing_flag_after_event(
            spec.df, spec.group_col, spec.date_col, rule.type_col, rule.event_value,
            rule.flag_col, rule.tie_break,
        )
        yield as_issues(
            found, spec.name, NO_FLAG, spec.group_col, spec.date_col, spec.id_col or spec.group_col
        )


def _table_findings(spec: TableSpec, calendar: Calendar, checks: set[str]):
    rows = spec.between(calendar.start, calendar.end)
    if NOT_DAILY in checks:
        found = missing_dates_any(rows, spec.date_col, calendar)
        yield as_issues(found, spec.name, NOT_DAILY, rdate="rdate")
    if NOT_MONTHLY in checks:
        found = missing_months(rows, spec.date_col, calendar)
        yield as_issues(found, spec.name, NOT_MONTHLY, rdate="rdate")
    if BAD_ROW in checks:
        found = null_rows(rows, spec.id_col)
        yield as_issues(found, spec.name, BAD_ROW, spec.group_col, spec.date_col)
    if ORPHAN_ROW in checks:
        found = orphan_rows(rows, spec.reference, spec.id_col, spec.reference_key)
        yield as_issues(found, spec.name, ORPHAN_ROW, spec.group_col, spec.date_col, spec.id_col)
    if SIZE_JUMP in checks:
        found = group_change_abs(spec, calendar=calendar)
        yield as_issues(found, spec.name, SIZE_JUMP, spec.group_col, "rdate", metric="change")


def run_checks(
    specs: Sequence[TableSpec],
    calendar: Calendar,
    as_of: date,
    selected: Sequence[str] | None = None,
    style: str = "grouped",
    lag_days: int = 1,
    groups: Mapping[str, DataFrame] | None = None,
    within_span: bool = False,
) -> DataFrame:
    """Issue table of all chosen tables; tables not chosen add nothing.

    A name in ``selected`` that no table has is an error, as are checks that lack what they
    need (an id, a group, a reference, a rule) and chosen tables without a check of the
    style. ``groups`` has, by table name, groups that must be there in every year;
    ``within_span`` looks for missing dates between a group's first and last date only.

    ``style="grouped"`` judges each group up to the cutoff and sizes by their share
    of growth. ``style="table"`` judges each table as a whole over the full calendar
    and sizes by the number of rows gained.
    """
    if style not in ("grouped", "table"):
        raise ValueError(f"unknown style {style!r}")
    for names, what in ((selected, "selected"), (groups, "groups")):
        unknown = sorted(set(names or ()) - {spec.name for spec in specs})
        if unknown:
            raise ValueError(f"{what}: no table {', '.join(unknown)}")
    if style == "table" and (groups or within_span):
        raise ValueError("groups and within_span belong to the grouped style")
    expected = expected_by_year(calendar, as_of, lag_days)
    parts = []
    for spec in specs:
        if selected is not None and spec.name not in selected:
            continue
        checks = _fit(spec, style, selected is not None)
        if style == "grouped":
            listed = (groups or {}).get(spec.name)
            parts += _grouped_findings(spec, calendar, expected, checks, as_of, lag_days, listed, within_span)
        else:
            parts += _table_findings(spec, calendar, checks)
    return reduce(DataFrame.unionByName, parts) if parts else no_issues(calendar.spark)


def keep_issues(issues: DataFrame) -> DataFrame:
    """Compute the issue table once, so that several reports can be drawn from it.

    It is written below the shared folder and read back: later reports neither repeat
    the checks nor depend on the executors that ran them.
    """
    spark = issues.sparkSession
    path = scratch_path(spark, "issues")
    issues.write.parquet(path)
    return spark.read.schema(ISSUE_SCHEMA).parquet(path)
