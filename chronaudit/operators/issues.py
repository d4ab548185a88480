"""Reports drawn from the issue table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.functions.dates import iso_text
from chronaudit.functions.predicates import in_month, in_period
from chronaudit.model import (
    ISSUE_SCHEMA,
    NO_DATA,
    NO_FLAG,
    NO_ID,
    NO_REFERENCE,
    NOT_DAILY,
    NOT_MONTHLY,
    SIZE_JUMP,
)
from chronaudit.operators.calendar import single_row
from chronaudit.operators.ordered import numbered

# Messages of the per-date verdict.
VERDICT_NO_DATA = "no data"
VERDICT_BAD_ROWS = "problematic rows"
VERDICT_SUCCESS = "success"

# The column that stored findings are kept by, and its value for findings without a date.
MONTH, UNDATED = "month", "undated"

# Issue types that say "nothing there" as against "something wrong there".
ABSENCE_TYPES = (NO_DATA, NOT_DAILY, NOT_MONTHLY)
# Issue types that concern one day; all others concern the month around the date.
DAY_TYPES = (NO_DATA, NOT_DAILY)


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def _table_names(spark: SparkSession, tables: Iterable[str]) -> DataFrame:
    return single_row(spark).select(
        F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_name")
    )


def issue_summary(issues: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Counts per table; tables without findings are listed with zeros.

    Missing data and missing ids count distinct dates over all groups. Rows about
    missing flags come in pairs and are halved.
    """
    t = F.col("issue_type")
    # First to one row per table, type and date, so that no distinct count is needed.
    by_date = issues.groupBy("table_name", "issue_type", "rdate").agg(F.count(F.lit(1)).alias("n"))
    dated = F.lit(1).cast("long")

    def total(kind, amount):
        return F.coalesce(F.sum(F.when(t == kind, amount)), F.lit(0).cast("long"))

    has_date = F.when(F.col("rdate").isNotNull(), dated).otherwise(0)
    counts = by_date.groupBy("table_name").agg(
        total(NO_DATA, has_date).alias("missing_data"),
        total(NO_ID, has_date).alias("missing_id"),
        total(NO_REFERENCE, F.col("n")).alias("orphans"),
        total(SIZE_JUMP, F.col("n")).alias("size_jumps"),
        total(NO_FLAG, F.col("n")).alias("flag_rows"),
    )
    counts = _table_names(issues.sparkSession, tables).join(counts, "table_name", "left").fillna(0)
    return counts.select(
        "table_name",
        F.expr(
            "missing_data + missing_id + orphans + size_jumps + flag_rows div 2"
        ).alias("total_issues"),
        "missing_data",
        "missing_id",
        "orphans",
        "size_jumps",
        F.expr("flag_rows div 2").alias("missing_flags"),
    )


def issue_detail(issues: DataFrame, table: str, groups: Sequence[str], others: bool = False) -> DataFrame:
    """A table's findings by type and date, one column per group.

    A cell holds the finding's metric, or 1 where there is none. Findings without a
    group (unknown ids) keep their id and leave the group columns empty. A finding of a
    group that is not listed is an error, unless ``others`` asks for the two columns
    ``other_group`` and ``other_value``, with a row of its own for each such group.
    """
    rows = issues.where(F.col("table_name") == table)
    cell = F.coalesce("metric", F.lit(1.0))
    group = F.col("group_value")
    listed = group.isNull() | group.isin(*groups) if groups else group.isNull()
    cells = [F.max(F.when(group == g, cell)).alias(g) for g in groups]
    keys = ["issue_type", iso_text(F.col("rdate")).alias("rdate"), "entity_id"]
    if not others:
        said = F.concat(F.lit(f"{table}: findings of a group that is not listed: "), group)
        known = F.when(~listed, F.raise_error(said).cast("string")).otherwise(F.col("issue_type"))
        return rows.withColumn("issue_type", known).groupBy(*keys).agg(*cells)
    other = F.when(~listed, group).alias("other_group")
    found = rows.groupBy(*keys, other).agg(*cells, F.max(F.when(~listed, cell)).alias("other_value"))
    return found.select("issue_type", "rdate", "entity_id", *groups, "other_group", "other_value")


def issues_on_date(
    issues: DataFrame,
    day: date,
    exact: Sequence[tuple[str, str]] = (),
    monthly: Sequence[str] = (),
) -> DataFrame:
    """Findings that concern a date: daily checks on the day, all others in its month.

    ``exact`` lists further (table, issue type) pairs to be matched on the day;
    ``monthly`` names tables kept by month, whose missing dates concern the month. Of stored
    findings (``plans.findings``) only the month's folders are read.
    """
    if MONTH in issues.columns:
        issues = issues.where(F.col(MONTH) == f"{day:%Y-%m}").drop(MONTH)
    t = F.col("issue_type")
    by_day = t.isin(*DAY_TYPES) & ~F.col("table_name").isin(*monthly)
    for table, kind in exact:
        by_day = by_day | ((F.col("table_name") == table) & (t == kind))
    rdate = F.col("rdate")
    month = in_month(rdate, day.year, day.month)
    return issues.where(month & (~by_day | in_period(rdate, day, day)))


def date_verdict(
    issues: DataFrame,
    day: date,
    tables: Sequence[str],
    exact: Sequence[tuple[str, str]] = (),
    show_all: bool = False,
    monthly: Sequence[str] = (),
) -> DataFrame:
    """Per table: no data, problematic rows or success.

    Missing data hides problematic rows, unless ``show_all`` asks for one row each.
    """
    near = issues_on_date(issues.where(F.col("table_name").isin(*tables)), day, exact, monthly)
    absent = F.col("issue_type").isin(*ABSENCE_TYPES)
    state = near.groupBy("table_name").agg(
        F.bool_or(absent).alias("absent"), F.bool_or(~absent).alias("bad")
    )
    names = _table_names(issues.sparkSession, tables)
    state = names.join(state, "table_name", "left").fillna(False)
    if not show_all:
        verdict = (
            F.when(F.col("absent"), VERDICT_NO_DATA)
            .when(F.col("bad"), VERDICT_BAD_ROWS)
            .otherwise(VERDICT_SUCCESS)
        )
        return state.select("table_name", verdict.alias("verdict"))
    shown = F.filter(
        F.array(
            F.when(F.col("absent"), VERDICT_NO_DATA),
            F.when(F.col("bad"), VERDICT_BAD_ROWS),
            F.when(~F.col("absent") & ~F.col("bad"), VERDICT_SUCCESS),
        ),
        lambda v: v.isNotNull(),
    )
    return state.select("table_name", F.explode(shown).alias("verdict"))


def bad_dates(issues: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Distinct dates with any finding in the chosen tables."""
    if MONTH in issues.columns:
        issues = issues.where(F.col(MONTH) != UNDATED)
    return (
        issues.where(F.col("table_name").isin(*tables) & F.col("rdate").isNotNull())
        .select("rdate")
        .distinct()
    )


def join_by_date(frames: Mapping[str, DataFrame], date_col: str = "rdate", repeats: bool = False) -> DataFrame:
    """Tables side by side by date; dates that any of them has. Columns get the table's name.

    One shuffle for any number of tables, where chained full joins need one each. Rows
    without a date stay apart, each table's own. A date that occurs twice within a table
    is an error, unless ``repeats`` asks for all rows: those of one date are then numbered
    within their table, in order of their columns, and rows of the same number stand side
    by side, with the number as ``n``. Numbers are given in ranges of the rows (``numbered``),
    so a date with many rows is spread over many tasks, as are the rows without a date.
    """
    tagged, columns = [], []
    for name, df in frames.items():
        parts = {f"{name}_{c}": F.col(c) for c in df.columns if c != date_col}
        tagged.append(
            df.select(
                F.to_date(date_col).alias("rdate"),
                *[c.alias(n) for n, c in parts.items()],
                F.lit(name).alias("_from"),
            )
        )
        columns += parts
    stacked = tagged[0]
    for other in tagged[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    undated = F.when(F.col("rdate").isNull(), F.col("_from")).alias("_undated")
    cells = [F.max(c).alias(c) for c in columns]
    if repeats:
        placed = numbered(stacked, ["rdate", "_from"], columns, "n").withColumn("n", F.col("n").cast("int"))
        return placed.groupBy("rdate", undated, "n").agg(*cells).select("rdate", "n", *columns)
    counts = [F.count_if(F.col("_from") == n).alias(f"_n{i}") for i, n in enumerate(frames)]
    joined = stacked.groupBy("rdate", undated).agg(*cells, *counts)
    repeated = F.greatest(*[F.col(f"_n{i}") for i in range(len(frames))], F.lit(0))
    checked = F.when(repeated > 1, F.raise_error(F.lit("a date occurs twice in one table")).cast("date"))
    return joined.select(checked.otherwise(F.col("rdate")).alias("rdate"), *columns)
