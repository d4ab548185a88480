"""Calendar-shaped views of the findings: status per day, grids per month and year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronaudit.functions.dates import MONTH_NAMES, WEEKDAY_LABELS, is_weekend
from chronaudit.model import (
    BAD_ROW,
    NO_DATA,
    NO_ID,
    NO_REFERENCE,
    NOT_DAILY,
    NOT_MONTHLY,
    ORPHAN_ROW,
    SIZE_JUMP,
)

# Checks of the status matrix, as table and issue type.
MATRIX_CHECKS = {
    "portholding": ("portholding", BAD_ROW),
    "bmc_monthly": ("bmc_monthly", BAD_ROW),
    "div_ltm": ("div_ltm", BAD_ROW),
    "bmprices": ("bmprices", NOT_DAILY),
    "portreturn": ("portreturn", NOT_DAILY),
    "portholding_is_daily": ("portholding", NOT_DAILY),
    "bmc_monthly_is_monthly": ("bmc_monthly", NOT_MONTHLY),
    "univsnapshot_is_monthly": ("univsnapshot", NOT_MONTHLY),
    "div_ltm_is_monthly": ("div_ltm", NOT_MONTHLY),
    "univsnapshot": ("univsnapshot", SIZE_JUMP),
    "univ_notin_id": ("univsnapshot", ORPHAN_ROW),
}
# Order in which a day's reasons are tried.
REASON_ORDER = (
    "bmprices", "portreturn", "portholding_is_daily", "bmc_monthly", "portholding",
    "univsnapshot", "div_ltm", "bmc_monthly_is_monthly", "univsnapshot_is_monthly",
    "div_ltm_is_monthly", "univ_notin_id",
)
# Status codes and what they mean.
STATUS_CODES = {
    1: "not updated daily",
    2: "not updated monthly",
    3: "problematic rows or size change",
    4: "unknown ids",
    5: "holiday",
}
# Code of each issue type; where several meet on a day the later entry stands.
CODE_OF_TYPE = (
    ((BAD_ROW, SIZE_JUMP, NO_ID), 3),
    ((NOT_DAILY, NO_DATA), 1),
    ((NOT_MONTHLY,), 2),
    ((ORPHAN_ROW, NO_REFERENCE), 4),
)


def _per_table(days: DataFrame, tables: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(t) for t in tables])
    return days.withColumn("table_name", F.explode(names))


def month_grid(
    days: DataFrame,
    issues: DataFrame | None = None,
    tables: Sequence[str] = (),
    working_week: bool = False,
) -> DataFrame:
    """Week by weekday sheets, one cell per day, as text; cells outside the month are ''.

    Without issues a cell holds the day number, with issues the number of findings
    of the table on that day. ``working_week`` leaves out Saturday and Sunday.
    """
    labels = WEEKDAY_LABELS[:5] if working_week else WEEKDAY_LABELS
    sheet = ["year", "month", "week"]
    if issues is None:
        cells = days.withColumn("cell", F.col("day").cast("string"))
    else:
        sheet = ["table_name", *sheet]
        counts = issues.groupBy("table_name", F.col("rdate").alias("date")).agg(
            F.count(F.lit(1)).alias("n")
        )
        cells = _per_table(days, tables).join(counts, ["table_name", "date"], "left")
        cells = cells.withColumn("cell", F.coalesce("n", F.lit(0)).cast("string"))
    return cells.groupBy(*sheet).agg(
        *[
            F.coalesce(F.max(F.when(F.col("weekday") == i, F.col("cell"))), F.lit("")).alias(label)
            for i, label in enumerate(labels)
        ]
    )


def day_status(days: DataFrame, issues: DataFrame, tables: Sequence[str], as_of: date) -> DataFrame:
    """Per table and day the highest of: quality issue, weekend, holiday, today, later.

    ``later`` marks the rest of the current month; other days have no status ('none').
    """
    bad = issues.select("table_name", F.col("rdate").alias("date")).distinct().withColumn("bad", F.lit(True))
    d, today = F.col("date"), F.lit(as_of)
    this_month = F.trunc(d, "month") == F.trunc(today, "month")
    status = (
        F.when(F.col("bad"), "quality issue")
        .when(is_weekend(d), "weekend")
        .when(F.col("holiday_flag") == 1, "holiday")
        .when(d == today, "today")
        .when(this_month & (d > today), "later")
        .otherwise("none")
    )
    marked = _per_table(days, tables).join(bad, ["table_name", "date"], "left")
    return marked.select("table_name", d.alias("rdate"), status.alias("status"))


def status_matrix(
    days: DataFrame, issues: DataFrame, checks: Mapping[str, tuple[str, str]] = MATRIX_CHECKS
) -> DataFrame:
    """One row per day, one boolean per check, and the holiday flag."""
    found = issues.where(F.col("rdate").isNotNull()).groupBy(F.col("rdate").alias("date")).agg(
        *[
            F.bool_or((F.col("table_name") == t) & (F.col("issue_type") == k)).alias(name)
            for name, (t, k) in checks.items()
        ]
    )
    return days.join(found, "date", "left").select(
        F.col("date").alias("rdate"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in checks],
        (F.col("holiday_flag") == 1).alias("holiday"),
    )


def status_codes(
    days: DataFrame, issues: DataFrame, tables: Sequence[str], monthly: Sequence[str] = ()
) -> DataFrame:
    """One row per day, one code per table (0: nothing found), and 5 on holidays.

    ``monthly`` names tables kept by month, whose missing dates mean "not monthly".
    """
    t = F.col("issue_type")
    t = F.when((t == NO_DATA) & F.col("table_name").isin(*monthly), NOT_MONTHLY).otherwise(t)
    rank = F.lit(0)
    for place, (kinds, _) in enumerate(CODE_OF_TYPE, start=1):
        rank = F.when(t.isin(*kinds), place).otherwise(rank)
    code = F.element_at(
        F.array(F.lit(0), *[F.lit(c) for _, c in CODE_OF_TYPE]), F.col("rank") + F.lit(1)
    )
    ranked = issues.where(F.col("rdate").isNotNull()).groupBy("table_name", F.col("rdate").alias("date"))
    coded = ranked.agg(F.max(rank).alias("rank")).withColumn("code", code)
    wide = coded.groupBy("date").agg(
        *[F.max(F.when(F.col("table_name") == n, F.col("code"))).alias(n) for n in tables]
    )
    return days.join(wide, "date", "left").select(
        F.col("date").alias("rdate"),
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in tables],
        F.when(F.col("holiday_flag") == 1, 5).otherwise(0).alias("holiday"),
    )


def day_reason(matrix: DataFrame, as_of: date, order: Sequence[str] = REASON_ORDER) -> DataFrame:
    """The first reason that applies to each day; days after ``as_of`` have none."""
    today = F.lit(as_of)
    reason = F.when(F.col("rdate") > today, "none").when(F.col("holiday"), "holiday")
    reason = reason.when(F.col("rdate") == today, "today")
    for check in order:
        reason = reason.when(F.col(check), check)
    return matrix.select("rdate", reason.otherwise("none").alias("reason"))


def iso_week_grid(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """ISO week, counted from the first one found, by weekday; of several values of a day the largest.

    A week of one year is not that of another: weeks go on being counted over the years,
    each with its own row.
    """
    d = F.to_date(date_col)
    monday = F.to_date(F.date_trunc("week", d))
    grid = df.where(F.col(date_col).isNotNull()).groupBy(monday.alias("monday")).agg(
        *[F.max(F.when(F.weekday(d) == i, F.col(value_col))).alias(n) for i, n in enumerate(WEEKDAY_LABELS)]
    )
    # One row per week is left, at most a few hundred thousand in all of the date type.
    first = F.min("monday").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    weeks = F.expr("cast(datediff(monday, first) div 7 as int)")
    return grid.withColumn("first", first).select(weeks.alias("week"), *WEEKDAY_LABELS)


def year_month_status(issues: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Year by month: is there any finding? Years without findings are listed too."""
    rdate = F.col("rdate")
    found = issues.where(rdate.isNotNull()).groupBy(F.year(rdate).alias("year")).agg(
        *[F.bool_or(F.month(rdate) == i).alias(n) for i, n in enumerate(MONTH_NAMES, start=1)]
    )
    years = issues.sparkSession.range(first_year, last_year + 1, 1, 1).select(F.col("id").cast("int").alias("year"))
    return years.join(found, "year", "left").fillna(False)
