"""What is audited (``TableSpec``) and what an audit yields (the issue table)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.functions.predicates import in_period

# Issue types of the grouped checks.
NO_DATA = "no_data"
NO_ID = "no_fsym_id"
NO_REFERENCE = "no_adjprice"
SIZE_JUMP = "universe_size"
NO_FLAG = "no_div_init_flag"
# Issue types of the whole-table checks.
NOT_DAILY = "is_daily"
NOT_MONTHLY = "is_monthly"
BAD_ROW = "problem_row"
ORPHAN_ROW = "notin_id"

GROUPED_CHECKS = (NO_DATA, NO_ID, NO_REFERENCE, SIZE_JUMP, NO_FLAG)
TABLE_CHECKS = (NOT_DAILY, NOT_MONTHLY, BAD_ROW, ORPHAN_ROW, SIZE_JUMP)

ISSUE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("group_value", T.StringType()),
    T.StructField("rdate", T.DateType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("metric", T.DoubleType()),
])


@dataclass(frozen=True)
class EventRule:
    """A follow-up to an event must carry a flag (``missing_flag_after_event``).

    Without ``tie_break`` rows of one date are in order of all their columns.
    """

    type_col: str
    event_value: str
    flag_col: str
    tie_break: Sequence[str] = ()


@dataclass(frozen=True)
class TableSpec:
    """A dated table and what is expected of it.

    ``checks`` names the issue types to look for. ``year_col`` names the partition
    column when the table is stored by year, so that period filters prune folders.
    """

    name: str
    df: DataFrame = field(repr=False)
    date_col: str = "rdate"
    group_col: str | None = None
    id_col: str | None = None
    frequency: str | None = "daily"
    description: str = ""
    checks: Sequence[str] = (NO_DATA,)
    reference: DataFrame | None = field(default=None, repr=False)
    reference_key: str | None = None
    growth_threshold: float = 0.01
    change_tolerance: int = 300
    event_rule: EventRule | None = None
    year_col: str | None = None

    def __post_init__(self):
        wanted = [self.date_col, self.group_col, self.id_col, self.year_col]
        if self.event_rule is not None:
            rule = self.event_rule
            wanted += [rule.type_col, rule.flag_col, *rule.tie_break]
        missing = [c for c in wanted if c is not None and c not in self.df.columns]
        if missing:
            raise ValueError(f"{self.name}: no column {', '.join(missing)}")
        if self.frequency not in ("daily", "monthly", None):
            raise ValueError(f"{self.name}: unknown frequency {self.frequency!r}")
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r}: a table name holds letters, digits and underscores")
        unknown = set(self.checks) - set(GROUPED_CHECKS) - set(TABLE_CHECKS)
        if unknown:
            raise ValueError(f"{self.name}: unknown checks {sorted(unknown)}")
        if (self.reference is None) != (self.reference_key is None):
            raise ValueError(f"{self.name}: reference and reference_key go together")
        if self.reference is not None and self.reference_key not in self.reference.columns:
            raise ValueError(f"{self.name}: reference has no column {self.reference_key}")

    def between(self, start: date, end: date) -> DataFrame:
        """Rows of a period, filtered by bounds on the stored columns."""
        rows = self.df.where(in_period(F.col(self.date_col), start, end))
        if self.year_col is not None:
            rows = rows.where(F.col(self.year_col).between(start.year, end.year))
        return rows


def as_issues(
    found: DataFrame,
    table_name: str,
    issue_type: str | None,
    group: str | None = None,
    rdate: str | None = None,
    entity: str | None = None,
    metric: str | None = None,
) -> DataFrame:
    """Shape a check's result into the issue schema; parts without a column are null.

    Without ``issue_type`` the result carries its own.
    """

    def part(column, kind):
        return f"cast({'null' if column is None else f'`{column}`'} as {kind})"

    return found.selectExpr(
        f"'{table_name}' as table_name",
        "issue_type" if issue_type is None else f"'{issue_type}' as issue_type",
        f"{part(group, 'string')} as group_value",
        f"{part(rdate, 'date')} as rdate",
        f"{part(entity, 'string')} as entity_id",
        f"{part(metric, 'double')} as metric",
    )
