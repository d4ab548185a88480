"""Date expressions.

All of them take and return Spark columns, so they run inside generated code and
can be pushed to the scan where the source allows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the weekday columns in calendar grids, Monday first.
WEEKDAY_LABELS = ("M", "T", "W", "Th", "F", "S", "Su")
# Month columns of the year grid.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
# Text forms of dates found in delivered files, and how to tell them apart.
TEXT_DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/y H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{8}$", "yyyyMMdd"),
)


def week_of_month(d: Column) -> Column:
    """Row of a Monday-first month sheet that holds the day, counted from 1."""
    lead_in = F.weekday(F.trunc(d, "month"))
    return F.ceil((F.day(d) + lead_in) / F.lit(7.0)).cast("int")


def weekday_label(d: Column) -> Column:
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    return F.element_at(labels, F.weekday(d) + F.lit(1))


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def iso_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def is_month_end(d: Column) -> Column:
    return d == F.last_day(d)


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def days_between(start: Column, end: Column) -> Column:
    """Array with every day from start to end, both included; empty if reversed."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(
        F.array().cast("array<date>")
    )


def month_ends_between(start: Column, end: Column) -> Column:
    """Array with the month ends that fall between two days, both included."""
    last = F.greatest(start, end)
    firsts = F.sequence(F.trunc(start, "month"), last, F.expr("interval 1 month"))
    return F.filter(F.transform(firsts, F.last_day), lambda d: d <= end)


def last_sunday_before(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 8), "SUN")


def parse_text_date(c: Column) -> Column:
    """Date from any of the known text forms; null when none of them fits.

    The form is told by its shape first: trying one format after another would raise
    an error inside the parser for most rows.
    """
    text = F.trim(c)
    forms = [F.when(text.rlike(p), F.try_to_date(text, f)) for p, f in TEXT_DATE_FORMATS]
    return F.coalesce(*forms)
