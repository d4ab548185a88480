"""Audits of dated tables for completeness and integrity, as Spark jobs."""

from chronaudit.model import EventRule, TableSpec
from chronaudit.operators.calendar import (
    Calendar,
    business_calendar,
    calendar_spanning,
    holidays,
)
from chronaudit.operators.completeness import (
    date_coverage,
    date_flags,
    missing_dates,
    missing_dates_any,
    missing_month_ends,
    missing_months,
    stale_weekly,
)
from chronaudit.operators.events import (
    date_gaps,
    irregular_gap_days,
    irregular_gaps,
    missing_flag_after_event,
)
from chronaudit.operators.integrity import (
    null_id_dates,
    null_rows,
    orphan_ids,
    orphan_rows,
    row_mismatch,
    unmatched_events,
)
from chronaudit.operators.issues import (
    bad_dates,
    date_verdict,
    issue_detail,
    issue_summary,
    issues_on_date,
    join_by_date,
)
from chronaudit.operators.size import group_change_abs, group_growth
from chronaudit.operators.status import (
    day_reason,
    day_status,
    iso_week_grid,
    month_grid,
    status_codes,
    status_matrix,
    year_month_status,
)
from chronaudit.plans.audit import keep_issues, run_checks

__all__ = [
    "Calendar", "EventRule", "TableSpec", "bad_dates", "business_calendar", "calendar_spanning",
    "date_coverage", "date_flags", "date_gaps", "date_verdict", "day_reason", "day_status",
    "group_change_abs", "group_growth", "holidays", "irregular_gap_days", "irregular_gaps",
    "iso_week_grid", "issue_detail", "issue_summary", "issues_on_date", "join_by_date",
    "keep_issues",
    "missing_dates", "missing_dates_any", "missing_flag_after_event", "missing_month_ends",
    "missing_months", "month_grid", "null_id_dates", "null_rows", "orphan_ids", "orphan_rows",
    "row_mismatch", "run_checks", "stale_weekly", "status_codes", "status_matrix",
    "unmatched_events", "year_month_status",
]
