"""Audit states that merge, so that a new delivery is audited without reading the old rows.

A state has a row for each group and year: its days as bits, the days with null ids as bits,
numbers of rows and of null ids, and the rows of each day. States of parts merge by ``bit_or``
and by sums. A delivery's state is published under its name, so a repeated one counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.functions import daybits
from chronaudit.model import NO_DATA, NO_ID, SIZE_JUMP, TableSpec, as_issues
from chronaudit.operators.calendar import Calendar
from chronaudit.operators.rollup import expected_by_year, growth, judged_years, jumps, with_previous
from chronaudit.sources.publish import BatchTable

_BITS = [*daybits.names("seen"), *daybits.names("faulty")]
STATE_SCHEMA = (
    "group_value string, year int, " + ", ".join(f"{c} bigint" for c in _BITS)
    + ", n_rows bigint, n_null_ids bigint, sizes array<struct<slot: int, n: bigint>>"
)
#: Checks that a state is enough for; the others need the rows themselves.
STATE_CHECKS = (NO_DATA, NO_ID, SIZE_JUMP)


def audit_state(spec: TableSpec) -> DataFrame:
    """The state of a table, or of the part of it that ``spec`` has: one row per group and year.

    Rows without a group or a date are left out, as in the audit. Rows are first reduced to
    one per group and day, which combines before the shuffle.
    """
    if spec.group_col is None:
        raise ValueError(f"{spec.name}: grouped checks need a group column")
    group, dated = F.col(spec.group_col), F.col(spec.date_col)
    nulls = F.lit(0).cast("long") if spec.id_col is None else F.count_if(F.col(spec.id_col).isNull())
    days = (
        spec.df.where(group.isNotNull() & dated.isNotNull())
        .groupBy(group.cast("string").alias("group_value"), F.to_date(dated).alias("rdate"))
        .agg(F.count(F.lit(1)).alias("n"), nulls.alias("n_null"))
        .selectExpr("group_value", "year(rdate) as year", f"cast({daybits.slot('rdate')} as int) as slot", "n", "n_null")
    )
    return days.groupBy("group_value", "year").agg(
        *daybits.gather("seen", "slot"), *daybits.gather("faulty", "slot", "n_null > 0"),
        F.sum("n").alias("n_rows"), F.sum("n_null").alias("n_null_ids"),
        F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("sizes"),
    )


def merged(state: DataFrame) -> DataFrame:
    """One row per group and year of any number of states, without the sizes of days."""
    return state.groupBy("group_value", "year").agg(
        *[F.bit_or(c).alias(c) for c in _BITS], F.sum("n_rows").alias("n_rows"), F.sum("n_null_ids").alias("n_null_ids"))


def day_sizes(state: DataFrame) -> DataFrame:
    """group_value, rdate and n_rows of any number of states."""
    days = state.select("group_value", "year", F.inline("sizes")).groupBy("group_value", "year", "slot").agg(F.sum("n").alias("n_rows"))
    return days.select("group_value", F.expr("date_add(make_date(year, 1, 1), slot)").alias("rdate"), "n_rows")


def state_issues(
    state: DataFrame,
    table_name: str,
    calendar: Calendar,
    as_of: date,
    checks: Sequence[str] = (NO_DATA,),
    frequency: str = "daily",
    growth_threshold: float = 0.01,
    lag_days: int = 1,
) -> DataFrame:
    """The issue table that ``run_checks`` would give for all rows behind the state."""
    wanted = set(checks)
    if not wanted or wanted - set(STATE_CHECKS):
        raise ValueError(f"{table_name}: a state answers {', '.join(STATE_CHECKS)}")
    years = state.where(F.col("year").between(calendar.start.year, calendar.end.year))
    span = calendar.days().withColumn("slot", F.expr(daybits.slot("date"))).groupBy("year").agg(*daybits.gather("span", "slot"))
    # a group is expected in years in which it has rows within the calendar
    per_year = merged(years).join(F.broadcast(span), "year").where(daybits.some_shared("span", "seen"))
    if SIZE_JUMP in wanted:
        within = day_sizes(years).where(F.col("rdate").between(F.lit(calendar.start), F.lit(calendar.end)))
        grown = with_previous(within).withColumn("growth", growth()).groupBy("group_value", F.year("rdate").alias("year"))
        per_year = per_year.join(grown.agg(jumps(growth_threshold)), ["group_value", "year"], "left")
    found = judged_years(per_year, expected_by_year(calendar, as_of, lag_days), wanted, frequency)
    return as_issues(found, table_name, None, "group_value", "rdate", None, "metric")


class AuditState:
    """The states of a table's deliveries, below a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path, STATE_SCHEMA)

    def add(self, delivery: TableSpec, batch: str) -> bool:
        """Add a delivery's state; False if a delivery of this name was added before. Only its rows are read."""
        return self.table.append(audit_state(delivery), batch) > 0

    def issues(self, table_name: str, calendar: Calendar, as_of: date, **how) -> DataFrame:
        """``state_issues`` of all deliveries so far."""
        return state_issues(self.table.read(), table_name, calendar, as_of, **how)
