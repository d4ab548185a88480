"""Filters written so that Catalyst can push them to the scan.

``year(d) = 2021`` hides the column from the Parquet statistics, a pair of bounds
does not; the period filters below therefore always compare the bare column with
literals.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_period(c: Column, start: date, end: date) -> Column:
    """Whole days from start to end, both included; works for dates and timestamps."""
    return (c >= F.lit(start)) & (c < F.lit(end + timedelta(days=1)))


def in_year(c: Column, year: int) -> Column:
    return in_period(c, date(year, 1, 1), date(year, 12, 31))


def in_month(c: Column, year: int, month: int) -> Column:
    following = date(year + month // 12, month % 12 + 1, 1)
    return in_period(c, date(year, month, 1), following - timedelta(days=1))


def _spelled_between(c: Column, values: list[str]) -> list[Column]:
    """Bounds that every spelling of the values keeps to, whatever the case of its letters.

    In code points a text lies between its spellings in capitals and in small letters. That
    holds for ASCII; the letter k also is the small letter of a sign outside of it, which
    sorts after them all, so a value with that letter has no upper bound.
    """
    if not values or not all(v.isascii() for v in values):
        return []
    bounds = [c >= min(v.upper() for v in values)]
    if not any("k" in v.lower() for v in values):
        bounds.append(c <= max(v.lower() for v in values))
    return bounds


def text_in(c: Column, values: Iterable[str]) -> Column:
    """Membership that ignores case, as in the usual database collation.

    The comparison of lower-cased texts is hidden from the scan; bounds on the bare column
    beside it are not, and let Parquet skip what cannot match.
    """
    values = list(values)
    wanted = F.lower(c).isin([v.lower() for v in values])
    for bound in _spelled_between(c, values):
        wanted = bound & wanted
    return wanted


def text_not_in(c: Column, values: Iterable[str]) -> Column:
    """SQL ``NOT IN``, ignoring case: a null text is dropped."""
    return ~text_in(c, values)


def differs(c: Column, value) -> Column:
    """Not equal, where null counts as different (pandas ``!=``)."""
    return ~c.eqNullSafe(F.lit(value))


def is_set(flag: Column) -> Column:
    """True flag; null counts as not set."""
    return F.coalesce(flag, F.lit(False))
