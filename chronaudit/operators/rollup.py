"""What the grouped checks share: presence per group and year, and row counts per date.

Presence (which days a group has) is gathered as bits straight from the table, in
one shuffle. Row counts need a rollup to one row per group and date; partial
aggregation collapses a hot group before the shuffle, and afterwards no group has
more rows than the calendar has days, so windows over a group stay small.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronaudit.functions import daybits
from chronaudit.model import NO_DATA, NO_ID, SIZE_JUMP, TableSpec
from chronaudit.operators.calendar import Calendar


def rollup(spec: TableSpec, calendar: Calendar | None = None) -> DataFrame:
    """group, rdate, n_rows, n_null_ids; rows without a group or a date are left out."""
    if spec.group_col is None:
        raise ValueError(f"{spec.name}: grouped checks need a group column")
    rows = spec.df if calendar is None else spec.between(calendar.start, calendar.end)
    rows = rows.where(F.col(spec.group_col).isNotNull() & F.col(spec.date_col).isNotNull())
    nulls = F.lit(0).cast("long") if spec.id_col is None else F.count_if(F.col(spec.id_col).isNull())
    return rows.groupBy(
        F.col(spec.group_col).alias("group_value"), F.to_date(spec.date_col).alias("rdate")
    ).agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_null_ids"))


def with_previous(roll: DataFrame) -> DataFrame:
    """Add the row count of the group's previous date (null on its first date)."""
    by_date = Window.partitionBy("group_value").orderBy("rdate")
    return roll.withColumn("previous", F.lag("n_rows").over(by_date))


def growth():
    """Change against the previous date, as a share of the current count."""
    return (F.col("n_rows") - F.col("previous")) / F.col("n_rows")


def cutoff(as_of: date, lag_days: int = 1) -> date:
    """Days before this one must be present; the lag allows for late delivery."""
    return as_of - timedelta(days=lag_days)


def expected_by_year(calendar: Calendar, as_of: date, lag_days: int = 1) -> DataFrame:
    """One row per calendar year with the days that must be there.

    ``daily`` holds business days, ``monthly`` month ends (weekends included), each as
    an array and as day bits. At most 366 entries per year, so it may be broadcast.
    """
    due = calendar.days().where(F.col("date") < F.lit(cutoff(as_of, lag_days)))
    month_end = "date = last_day(date)"
    return due.withColumn("slot", F.expr(daybits.slot("date"))).groupBy("year").agg(
        F.expr("collect_list(date) filter (where bday)").alias("daily"),
        F.expr(f"collect_list(date) filter (where {month_end})").alias("monthly"),
        *daybits.gather("daily", "slot", "bday"),
        *daybits.gather("monthly", "slot", month_end),
    )


def dated_rows(spec: TableSpec, calendar: Calendar) -> DataFrame:
    """group_value, rdate, year, slot and id_missing of every row with a group and a date."""
    if spec.group_col is None:
        raise ValueError(f"{spec.name}: grouped checks need a group column")
    group, dated = F.col(spec.group_col), F.col(spec.date_col)
    id_missing = F.lit(False) if spec.id_col is None else F.col(spec.id_col).isNull()
    rows = spec.between(calendar.start, calendar.end).where(group.isNotNull() & dated.isNotNull())
    return rows.select(
        group.alias("group_value"), F.to_date(dated).alias("rdate"), id_missing.alias("id_missing")
    ).selectExpr("*", "year(rdate) as year", f"{daybits.slot('rdate')} as slot")


_FOUND = "array<struct<issue_type:string,rdate:date,metric:double>>"


def _candidates(issue_type: str, days: str) -> str:
    return (
        f"transform({days}, d -> named_struct('issue_type', '{issue_type}', 'rdate', d,"
        f" 'metric', cast(null as double))) as {issue_type}_days"
    )


def profile(spec: TableSpec, calendar: Calendar, expected: DataFrame, wanted: set[str]) -> DataFrame:
    """Missing dates, null-id dates and size jumps of a table from one scan.

    ``expected`` comes from ``expected_by_year``. Returns group_value, issue_type,
    rdate and metric.
    """
    rows = dated_rows(spec, calendar)
    id_missing = "id_missing"
    collected = []
    if SIZE_JUMP in wanted:
        rows = with_previous(rollup(spec, calendar)).withColumn("growth", growth())
        rows = rows.selectExpr("*", "year(rdate) as year", f"{daybits.slot('rdate')} as slot")
        id_missing = "n_null_ids > 0"
        collected.append(jumps(spec.growth_threshold))
    if NO_DATA in wanted:
        collected += daybits.gather("seen", "slot")
    if NO_ID in wanted:
        collected += daybits.gather("faulty", "slot", id_missing)
    per_year = rows.groupBy("group_value", "year").agg(*collected)
    return judged_years(per_year, expected, wanted, spec.frequency or "daily")


def jumps(threshold: float) -> Column:
    """An aggregate: the dates whose growth is above the threshold, as findings."""
    return F.expr(
        f"collect_list(named_struct('issue_type', '{SIZE_JUMP}', 'rdate', rdate, 'metric', growth))"
        f" filter (where growth > {threshold!r}D)"
    ).alias("jumps")


def judged_years(per_year: DataFrame, expected: DataFrame, wanted: set[str], due: str) -> DataFrame:
    """Findings of groups and years from their day bits (``seen``, ``faulty``) and ``jumps``."""
    candidates, sources, tests = [], [], []
    if SIZE_JUMP in wanted:
        sources.append("jumps")
        tests.append(f"issue_type = '{SIZE_JUMP}'")
    if NO_DATA in wanted:
        candidates.append(_candidates(NO_DATA, due))
        sources.append(f"if({daybits.some_absent(due, 'seen')}, {NO_DATA}_days, null)")
        tests.append(f"issue_type = '{NO_DATA}' and not {daybits.member('seen', 'rdate')}")
    if NO_ID in wanted:
        candidates.append(_candidates(NO_ID, "daily"))
        sources.append(f"if({daybits.some_shared('daily', 'faulty')}, {NO_ID}_days, null)")
        tests.append(f"issue_type = '{NO_ID}' and {daybits.member('faulty', 'rdate')}")
    listed = expected.selectExpr(
        "year", *daybits.names("daily"), *daybits.names("monthly"), *candidates
    )
    # Left join: a year with nothing due yet still keeps its size jumps.
    joined = per_year.join(F.broadcast(listed), "year", "left")
    days = ", ".join(f"coalesce({s}, cast(array() as {_FOUND}))" for s in sources)
    sets = [c for c in per_year.columns if c.startswith(("seen_", "faulty_"))]
    unrolled = joined.selectExpr("group_value", *sets, f"inline(concat({days}))")
    return unrolled.where(" or ".join(f"({t})" for t in tests)).select(
        "group_value", "issue_type", "rdate", "metric"
    )
