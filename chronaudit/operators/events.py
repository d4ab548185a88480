"""Checks on the order of events and on gaps between dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronaudit.functions.predicates import is_set
from chronaudit.operators.ordered import free_names, neighbours


def missing_flag_after_event(
    df: DataFrame,
    key: str,
    date_col: str,
    type_col: str,
    event_value: str,
    flag_col: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """An event's next row without its flag, together with the event itself.

    Each key's latest row is not judged. A row that is both a faulty follow-up and
    an event with a faulty follow-up appears once. Rows that share a date are in order of
    ``tie_break``, or of all other columns if none is given, so that only one of them is
    the latest; rows that are equal in all columns are one event. Columns may have any names.
    """
    order = [date_col, *(list(tie_break) or [c for c in df.columns if c not in (key, date_col)])]
    near = neighbours(df, key, order, [type_col, flag_col])

    def field(of: str, name: str) -> Column:
        return F.col(of).getField(name)

    def position(of: str) -> Column:
        return F.struct(*[field(of, c) for c in order])

    last = position("latest")
    faulty = (
        (field("previous", type_col) == event_value) & ~is_set(field("row", flag_col)) & (position("row") != last)
    )
    leads_to_faulty = (
        (field("row", type_col) == event_value)
        & F.col("next").isNotNull()
        & ~is_set(field("next", flag_col))
        & (position("next") != last)
    )
    return near.where(is_set(faulty) | is_set(leads_to_faulty)).select("row.*")


def date_gaps(df: DataFrame, group: str, date_col: str, first_gap: int = 1) -> DataFrame:
    """group, rdate, n_rows and diff_days to the group's previous date.

    A group's first date gets ``first_gap``. Rows that share a date are counted in
    n_rows; all but one of them stand at gap 0.
    """
    days = (
        df.where(F.col(group).isNotNull() & F.col(date_col).isNotNull())
        .groupBy(group, F.to_date(date_col).alias("rdate"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    before = F.lag("rdate").over(Window.partitionBy(group).orderBy("rdate"))
    gap = F.coalesce(F.datediff("rdate", before), F.lit(first_gap))
    return days.withColumn("diff_days", gap)


def _unexplained(gap: Column, d: Column, after_holiday: Column, after_long_weekend: Column) -> Column:
    """The gap is neither the usual step nor due to a weekend or holiday."""
    monday = F.weekday(d) == 0
    fine = (
        (gap == 1)
        | (monday & (gap == 3))
        | after_holiday
        | (monday & (gap == 4) & after_long_weekend)
    )
    return ~fine


def _with_verdict(gaps: DataFrame, holidays: DataFrame | None, holiday_col: str) -> DataFrame:
    """Add gap_bad and repeat_bad (the same rule at gap 0)."""
    if holidays is None:
        marked = gaps.withColumns(
            {"after_holiday": F.lit(False), "after_long_weekend": F.lit(False)}
        )
    else:
        days = holidays.select(F.to_date(holiday_col).alias("h")).dropna()
        shifted = days.select(
            F.date_add("h", 1).alias("rdate"), F.lit(True).alias("y"), F.lit(False).alias("f")
        ).unionByName(
            days.select(
                F.date_add("h", 3).alias("rdate"), F.lit(False).alias("y"), F.lit(True).alias("f")
            )
        )
        lookup = shifted.groupBy("rdate").agg(
            F.bool_or("y").alias("after_holiday"), F.bool_or("f").alias("after_long_weekend")
        )
        marked = gaps.join(lookup, "rdate", "left").fillna(
            False, subset=["after_holiday", "after_long_weekend"]
        )
    args = F.col("rdate"), F.col("after_holiday"), F.col("after_long_weekend")
    return marked.withColumns(
        {
            "gap_bad": _unexplained(F.col("diff_days"), *args),
            "repeat_bad": (F.col("n_rows") > 1) & _unexplained(F.lit(0), *args),
        }
    )


def irregular_gap_days(
    df: DataFrame,
    group: str,
    date_col: str,
    holidays: DataFrame | None = None,
    holiday_col: str = "holiday_date",
    first_gap: int = 1,
) -> DataFrame:
    """Flagged gaps as group, rdate, weekday, diff_days and the number of rows at fault."""
    judged = _with_verdict(date_gaps(df, group, date_col, first_gap), holidays, holiday_col)
    one = F.lit(1).cast("long")
    hits = F.array(
        F.when(F.col("gap_bad"), F.struct(F.col("diff_days"), one.alias("n_flagged"))),
        F.when(
            F.col("repeat_bad"),
            F.struct(F.lit(0).alias("diff_days"), (F.col("n_rows") - 1).alias("n_flagged")),
        ),
    )
    return judged.select(
        group,
        "rdate",
        F.weekday("rdate").alias("weekday"),
        F.inline(F.filter(hits, lambda h: h.isNotNull())),
    )


def irregular_gaps(
    df: DataFrame,
    group: str,
    date_col: str,
    holidays: DataFrame | None = None,
    order_by: Sequence[str] = (),
    holiday_col: str = "holiday_date",
    first_gap: int = 1,
) -> DataFrame:
    """The table's own rows behind the flagged gaps, with weekday and diff_days.

    Among rows that share group and date the first carries the gap to the previous date,
    the others gap 0. The first is that by ``order_by``, then the date and the other columns; of
    rows that are equal in all columns one is the first. The gaps are found on one row per
    group and date; only flagged days are joined back, and Spark splits a hot day on that
    join. The first rows of those days are a minimum, combined before the shuffle. Where the
    table has a column weekday or diff_days, the new one gets an underscore behind its name.
    """
    packed = df.select(
        F.col(group).alias("group"), F.to_date(date_col).alias("day"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    bad = (
        _with_verdict(date_gaps(packed, "group", "day", first_gap), holidays, holiday_col)
        .where(F.col("gap_bad") | F.col("repeat_bad"))
        .select("group", F.col("rdate").alias("day"), "gap_bad", "repeat_bad", "diff_days")
    )
    order = F.struct(*[F.col("row").getField(c) for c in dict.fromkeys([*order_by, date_col, *df.columns])])
    flagged = packed.join(bad, ["group", "day"])
    same = flagged.groupBy("row", *bad.columns).agg(F.count(F.lit(1)).alias("n"))
    first = same.groupBy("group", "day").agg(F.min(order).alias("first"))
    marked = same.join(first, ["group", "day"]).withColumn("is_first", order.eqNullSafe(F.col("first")))
    none = F.array().cast("array<int>")
    gaps = F.concat(
        F.when(F.col("is_first") & F.col("gap_bad"), F.array("diff_days")).otherwise(none),
        F.when(F.col("repeat_bad"), F.array_repeat(F.lit(0), (F.col("n") - F.col("is_first").cast("int")).cast("int")))
        .otherwise(none),
    )
    weekday, diff_days = free_names(df.columns, "weekday", "diff_days")
    return marked.select("row", F.weekday("day").alias("weekday"), F.explode(gaps).alias("gap")).select(
        "row.*", F.col("weekday").alias(weekday), F.col("gap").alias(diff_days))
