"""Which dates are there, which are not, and what has gone stale."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronaudit.functions import daybits
from chronaudit.functions.dates import days_between, last_sunday_before
from chronaudit.functions.predicates import in_period
from chronaudit.model import TableSpec
from chronaudit.operators.calendar import Calendar, single_row
from chronaudit.operators.rollup import cutoff, dated_rows, expected_by_year


def _absent(
    spec: TableSpec,
    calendar: Calendar,
    as_of: date,
    kind: str,
    lag_days: int,
    groups: DataFrame | None,
    within_span: bool,
) -> DataFrame:
    rows = dated_rows(spec, calendar).select("group_value", "rdate", "year", "slot")
    if groups is not None:
        # A listed group must be there every year; its null slot sets no bit.
        years = F.array(*[F.lit(y) for y in calendar.years])
        listed = groups.select(F.col(spec.group_col).alias("group_value")).where("group_value is not null")
        rows = rows.unionByName(
            listed.distinct().select("group_value", F.explode(years).alias("year")),
            allowMissingColumns=True,
        )
    present = rows.groupBy("group_value", "year").agg(
        *daybits.gather("seen", "slot"), F.min("rdate").alias("first"), F.max("rdate").alias("last")
    )
    if within_span:
        # One row per group and year is left, so a group is never large here.
        whole = Window.partitionBy("group_value")
        present = present.withColumns(
            {"first": F.min("first").over(whole), "last": F.max("last").over(whole)}
        )
    expected = F.broadcast(expected_by_year(calendar, as_of, lag_days))
    lacking = present.join(expected, "year").where(daybits.some_absent(kind, "seen"))
    due = lacking.select("group_value", "first", "last", *daybits.names("seen"), F.explode(kind).alias("rdate"))
    found = due.where("not " + daybits.member("seen", "rdate"))
    if within_span:
        found = found.where(F.col("rdate").between(F.col("first"), F.col("last")))
    return found.select(F.col("group_value").alias(spec.group_col), "rdate")


def missing_dates(
    spec: TableSpec,
    calendar: Calendar,
    as_of: date,
    lag_days: int = 1,
    groups: DataFrame | None = None,
    within_span: bool = False,
) -> DataFrame:
    """Business days before the cutoff on which a group has no row.

    A group is expected in every calendar year in which it has rows at all; ``groups``
    adds groups that must be there regardless. ``within_span`` keeps only days between
    a group's first and last date, which bounds the result when groups are many.
    """
    return _absent(spec, calendar, as_of, "daily", lag_days, groups, within_span)


def missing_month_ends(
    spec: TableSpec,
    calendar: Calendar,
    as_of: date,
    lag_days: int = 1,
    groups: DataFrame | None = None,
    within_span: bool = False,
) -> DataFrame:
    """Calendar month ends before the cutoff on which a group has no row."""
    return _absent(spec, calendar, as_of, "monthly", lag_days, groups, within_span)


def present_dates(df: DataFrame, date_col: str, calendar: Calendar) -> DataFrame:
    """Distinct days of the calendar's span found in a table, as ``date``."""
    return (
        df.where(in_period(F.col(date_col), calendar.start, calendar.end))
        .select(F.to_date(date_col).alias("date"))
        .distinct()
    )


def missing_dates_any(df: DataFrame, date_col: str, calendar: Calendar) -> DataFrame:
    """Business days of the whole calendar (future included) that the table lacks."""
    there = F.broadcast(present_dates(df, date_col, calendar))
    return calendar.business_days().join(there, "date", "left_anti").select(F.col("date").alias("rdate"))


def missing_months(df: DataFrame, date_col: str, calendar: Calendar) -> DataFrame:
    """Every day of each month in which the table has no row."""
    there = present_dates(df, date_col, calendar).select(F.trunc("date", "month").alias("first")).distinct()
    days = calendar.days().select(F.col("date").alias("rdate"), F.trunc("date", "month").alias("first"))
    return days.join(F.broadcast(there), "first", "left_anti").select("rdate")


def date_coverage(df: DataFrame, date_col: str, calendar: Calendar) -> DataFrame:
    """For each day that is no holiday (weekends included): does the table have it?"""
    there = F.broadcast(present_dates(df, date_col, calendar).withColumn("seen", F.lit(True)))
    open_days = calendar.days().where("holiday_flag = 0").select("date")
    return open_days.join(there, "date", "left").select(
        F.col("date").alias("rdate"), F.col("seen").isNotNull().alias("present")
    )


def date_flags(df: DataFrame, date_col: str, start: date, end: date) -> DataFrame:
    """0/1 per day from start up to, but without, end."""
    last = cutoff(end)
    days = single_row(df.sparkSession).select(
        F.explode(days_between(F.lit(start), F.lit(last))).alias("date")
    )
    there = (
        df.where(in_period(F.col(date_col), start, last))
        .select(F.to_date(date_col).alias("date"), F.lit(1).alias("seen"))
        .distinct()
    )
    return days.join(F.broadcast(there), "date", "left").select(
        F.col("date").alias("rdate"), F.coalesce("seen", F.lit(0)).alias("flag")
    )


def stale_weekly(
    df: DataFrame, dataset_col: str, updated_col: str, as_of: date, lag_days: int = 1
) -> DataFrame:
    """Datasets whose latest update precedes the last Sunday before the cutoff."""
    sunday = last_sunday_before(F.lit(cutoff(as_of, lag_days)))
    latest = df.groupBy(dataset_col).agg(F.to_date(F.max(updated_col)).alias("last_update"))
    return latest.where(F.col("last_update") < sunday).withColumn("due", sunday)
