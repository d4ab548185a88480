"""Business calendars and holiday lists."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.functions.dates import days_between, week_of_month
from chronaudit.functions.predicates import differs, in_period, in_year


def single_row(spark: SparkSession) -> DataFrame:
    """One row in one partition, to unroll literal lists from without a shuffle."""
    return spark.range(0, 1, 1, 1)


def _describe(days: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Add the calendar columns to days; ``flags`` holds date and holiday_flag."""
    if flags is None:
        marked = days.withColumn("holiday_flag", F.lit(0))
    else:
        marked = days.join(flags, "date", "left").fillna(0, subset=["holiday_flag"])
    described = marked.selectExpr(
        "date",
        "year(date) as year",
        "month(date) as month",
        "weekday(date) as weekday",
        "day(date) as day",
        "holiday_flag",
        "weekday(date) < 5 and holiday_flag = 0 as bday",
    )
    return described.withColumn("week", week_of_month(F.col("date")))


def _holiday_days(holidays: DataFrame, holiday_col: str, start: date, end: date) -> DataFrame:
    return (
        holidays.where(in_period(F.col(holiday_col), start, end))
        .select(F.to_date(holiday_col).alias("date"))
        .distinct()
    )


@dataclass(frozen=True)
class Calendar:
    """A span of days with its holidays.

    The span is known up front, so everything derived from it has a known size and
    may be broadcast: one row per day, at most one holiday per day.
    """

    spark: SparkSession = field(repr=False)
    start: date
    end: date
    holidays: DataFrame | None = field(default=None, repr=False)
    holiday_col: str = "holiday_date"

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("calendar ends before it starts")

    @classmethod
    def for_year(cls, spark, year: int, holidays=None, holiday_col="holiday_date") -> Calendar:
        return cls(spark, date(year, 1, 1), date(year, 12, 31), holidays, holiday_col)

    @property
    def years(self) -> range:
        return range(self.start.year, self.end.year + 1)

    @cached_property
    def _days(self) -> DataFrame:
        span = days_between(F.lit(self.start), F.lit(self.end))
        days = single_row(self.spark).select(F.explode(span).alias("date"))
        if self.holidays is None:
            return _describe(days, None)
        # Distinct days of the calendar's own span: never more rows than the calendar.
        known = _holiday_days(self.holidays, self.holiday_col, self.start, self.end)
        return _describe(days, F.broadcast(known.withColumn("holiday_flag", F.lit(1))))

    def days(self) -> DataFrame:
        """date, year, month, weekday (Monday 0), day, week, holiday_flag, bday."""
        return self._days

    def business_days(self) -> DataFrame:
        return self.days().where("bday").select("date")


def business_calendar(
    spark: SparkSession, start: date, end: date, holidays: DataFrame | None = None
) -> DataFrame:
    return Calendar(spark, start, end, holidays).days()


def calendar_spanning(
    df: DataFrame,
    date_col: str,
    holidays: DataFrame | None = None,
    holiday_col: str = "holiday_date",
) -> DataFrame:
    """Calendar from a table's first to its last day; the span is found by Spark."""
    bounds = df.agg(
        F.to_date(F.min(date_col)).alias("first"), F.to_date(F.max(date_col)).alias("last")
    ).where(F.col("first").isNotNull())
    days = bounds.select(F.explode(days_between(F.col("first"), F.col("last"))).alias("date"))
    if holidays is None:
        return _describe(days, None)
    # The list has no known span here, so the join is left to Spark.
    known = holidays.select(F.to_date(holiday_col).alias("date")).distinct()
    return _describe(days, known.withColumn("holiday_flag", F.lit(1)))


def holidays(
    df: DataFrame,
    us: bool = True,
    ca: bool = True,
    year: int | None = None,
    mode: str = "latest",
    code_col: str = "fref_exchange_code",
    date_col: str = "holiday_date",
) -> DataFrame:
    """Distinct holiday dates for the exchanges asked for.

    ``mode="latest"`` always keeps everything but TSE and adds TSE when ``ca`` is
    set. ``mode="flags"`` honours both switches; with neither the list is empty.
    """
    if mode not in ("latest", "flags"):
        raise ValueError(f"unknown mode {mode!r}")
    code = F.col(code_col)
    rows = df if year is None else df.where(in_year(F.col(date_col), year))
    if mode == "latest":
        if not ca:
            rows = rows.where(differs(code, "TSE"))
    elif not us and not ca:
        rows = rows.where(F.lit(False))
    elif not ca:
        rows = rows.where(code == "NYS")
    elif not us:
        rows = rows.where(code == "TSE")
    return rows.select(F.to_date(date_col).alias(date_col)).dropDuplicates()
