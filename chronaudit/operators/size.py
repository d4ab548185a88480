"""Sudden changes in the number of rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.model import TableSpec
from chronaudit.operators.calendar import Calendar
from chronaudit.operators.rollup import growth, rollup, with_previous


def group_growth(
    spec: TableSpec, threshold: float | None = None, calendar: Calendar | None = None
) -> DataFrame:
    """Dates on which a group grew by more than the threshold.

    Growth is the change since the group's previous date as a share of the current
    count; a group's first date and shrinkage are never reported.
    """
    limit = spec.growth_threshold if threshold is None else threshold
    sized = with_previous(rollup(spec, calendar)).withColumn("growth", growth())
    return sized.where(F.col("growth") > limit).select(
        F.col("group_value").alias(spec.group_col), "rdate", "n_rows", "growth"
    )


def group_change_abs(
    spec: TableSpec, tolerance: int | None = None, calendar: Calendar | None = None
) -> DataFrame:
    """Dates on which a group gained more than ``tolerance`` rows."""
    limit = spec.change_tolerance if tolerance is None else tolerance
    sized = with_previous(rollup(spec, calendar))
    change = F.col("n_rows") - F.col("previous")
    return sized.withColumn("change", change).where(F.col("change") > limit).select(
        F.col("group_value").alias(spec.group_col), "rdate", "n_rows", "change"
    )
