"""Null ids, unknown ids, unmatched events and differing rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronaudit.model import TableSpec
from chronaudit.operators.calendar import Calendar
from chronaudit.operators.ordered import free_names
from chronaudit.operators.prefilter import is_small, may_be_in
from chronaudit.operators.rollup import cutoff


def null_rows(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def null_id_dates(spec: TableSpec, calendar: Calendar, as_of: date, lag_days: int = 1) -> DataFrame:
    """Business days before the cutoff on which a group has a row without id.

    Business days count for monthly tables too. The null test reaches the scan, so
    only the faulty rows are shuffled.
    """
    group = F.col(spec.group_col)
    faulty = (
        spec.between(calendar.start, calendar.end)
        .where(F.col(spec.id_col).isNull() & group.isNotNull())
        .select(group, F.to_date(spec.date_col).alias("rdate"))
        .distinct()
    )
    due = (
        calendar.business_days()
        .where(F.col("date") < F.lit(cutoff(as_of, lag_days)))
        .select(F.col("date").alias("rdate"))
    )
    return faulty.join(F.broadcast(due), "rdate", "left_semi").select(spec.group_col, "rdate")


def set_membership(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of two one-schema inputs with ``in_left`` and ``in_right``.

    One shuffle of values already made distinct per task, so repeated values cost
    nothing and a hot value cannot overload a task. Null is a value like any other.
    """
    keys = left.columns
    tagged = left.withColumns({"_l": F.lit(True), "_r": F.lit(False)}).unionByName(
        right.toDF(*keys).withColumns({"_l": F.lit(False), "_r": F.lit(True)})
    )
    return tagged.groupBy(*keys).agg(
        F.bool_or("_l").alias("in_left"), F.bool_or("_r").alias("in_right")
    )


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT DISTINCT."""
    return set_membership(left, right).where("in_left and not in_right").drop("in_left", "in_right")


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """INTERSECT DISTINCT."""
    return set_membership(left, right).where("in_left and in_right").drop("in_left", "in_right")


def orphan_ids(df: DataFrame, ref: DataFrame, key: str, ref_key: str | None = None) -> DataFrame:
    """Distinct ids of a table that its reference table lacks; null is a value."""
    return difference(df.select(key), ref.select(ref_key or key))


def _without_partner(left: DataFrame, keys: Sequence[str], known: DataFrame, null_safe: bool) -> DataFrame:
    """Rows of left whose keys are not among those known.

    First the distinct keys of left alone meet the known ones. What is left of them makes a
    Bloom filter, which drops nearly all rows that have a partner while they are scanned;
    only the others are shuffled to meet the unknown keys themselves. Rows of a small table
    meet the known keys at once.
    """
    if is_small(left):
        found = known.toDF(*free_names(left.columns, *[f"_known{i}" for i in range(len(keys))])).distinct()
        pairs = [(F.col(a), F.col(b)) for a, b in zip(keys, found.columns, strict=True)]
        met_known = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
        return left.join(found, met_known, "left_anti")
    marked = [f"_k{i}" for i in range(len(keys))]
    own = left.select(*[F.col(k).alias(m) for k, m in zip(keys, marked, strict=True)])
    if not null_safe:
        own = own.dropna()
    found = known.toDF(*[f"_known{i}" for i in range(len(keys))]).distinct()

    def met(names: Sequence[str], others: Sequence[str]):
        pairs = [(F.col(a), F.col(b)) for a, b in zip(names, others, strict=True)]
        return reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])

    unknown = own.distinct().join(found, met(marked, found.columns), "left_anti")
    (row,) = free_names([*keys, *marked], "_row")
    packed = left.select(
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(row), *[F.col(k).alias(f"{m}_") for k, m in zip(keys, marked, strict=True)])
    own_keys = [f"{m}_" for m in marked]
    suspects = packed.where(may_be_in(unknown, [F.col(c) for c in own_keys]))
    orphans = suspects.join(unknown, met(own_keys, marked), "left_semi")
    if not null_safe:  # null keys never match, so their rows need no partner to be looked for
        absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in own_keys])
        orphans = orphans.unionByName(packed.where(absent))
    return orphans.select(f"{row}.*")


def orphan_rows(df: DataFrame, ref: DataFrame, key: str, ref_key: str | None = None) -> DataFrame:
    """Whole rows whose id the reference table lacks; a null id matches a null id.

    A large table is read twice, the first time for its ids alone; only rows without a partner,
    and the few that a filter takes for such, are shuffled.
    """
    return _without_partner(df, [key], ref.select(ref_key or key), null_safe=True)


def unmatched_events(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None
) -> DataFrame:
    """Rows of left without a partner in right; null keys never match. Shuffles as ``orphan_rows``."""
    return _without_partner(left, list(left_keys), right.select(*(right_keys or left_keys)), null_safe=False)


#: Buckets of keys whose digests are compared, first coarse and then fine.
LEVELS = (1 << 8, 1 << 16)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _digests(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], buckets: int) -> DataFrame:
    """Per bucket of keys the number of rows and sums of their hashes, whatever their order.

    Two hashes of 64 bits are summed by halves, which no number of rows overflows. Hashes
    pass over nulls, so which columns are null is hashed too.
    """
    hashed = [*cols, *[F.col(c).isNull() for c in cols]]
    halves = []
    for seed in (F.lit(1), F.lit("2")):
        h = F.xxhash64(seed, *hashed)
        halves += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(halves)]
    return rows.groupBy(_bucket(keys, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


def _differing(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], buckets: int) -> DataFrame:
    """The buckets whose rows are not the same in both; there are no more than ``buckets``."""
    digests = (_digests(x, keys, cols, buckets).withColumn("side", F.lit(side)) for side, x in enumerate((a, b)))
    both = reduce(DataFrame.unionByName, digests)
    sums = [c for c in both.columns if c not in ("bucket", "side")]
    apart = reduce(lambda x, y: x | y, [F.min(c) != F.max(c) for c in sums])
    return both.groupBy("bucket").agg((apart | (F.count(F.lit(1)) < 2)).alias("apart")).where("apart").select("bucket")


def _in_buckets(rows: DataFrame, keys: Sequence[str], found: DataFrame, buckets: int) -> DataFrame:
    return rows.join(F.broadcast(found), _bucket(keys, buckets) == F.col("bucket"), "left_semi")


def row_mismatch(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str] | str,
    compare: Sequence[str] | None = None,
    null_equal: bool = False,
) -> DataFrame:
    """Rows of b that differ from their counterpart in a in any compared column.

    Null differs from null unless ``null_equal``. A row of b that a lacks differs. Keys
    are matched with null as a value; where a has a key repeatedly, a row of b differs if
    none of those rows equals it. Every row of b is returned once at most.

    Buckets of keys are compared by digests first: 256 of them, then 65,536 within those that
    differ. Only rows in fine buckets that differ are shuffled and joined; tables that are
    equal move digests alone. Where types of the columns differ between the tables, which
    digests cannot tell from other values, and where b is small, all rows are joined.
    """
    keys = [key] if isinstance(key, str) else list(key)
    compare = list(compare or [c for c in a.columns if c not in keys and c in b.columns])
    given = [*keys, *compare]
    cols = [f"_c{i}" for i in range(len(given))]
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(given, cols, strict=True)]
    other, mine = a.select(*own), b.select(F.struct(*[F.col(f"`{c}`") for c in b.columns]).alias("_row"), *own)
    kinds = [[x.schema[c].dataType for c in given] for x in (a, b)]
    never = []  # rows with a null that equals nothing
    if not null_equal and compare:
        absent = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in cols[len(keys) :]])
        never = [mine.where(absent)]
        other, mine = other.where(~absent), mine.where(~absent)
    if kinds[0] == kinds[1] and not is_small(b):
        own_keys = cols[: len(keys)]
        for buckets in LEVELS:
            found = _differing(other, mine.select(*cols), own_keys, cols, buckets)
            other, mine = _in_buckets(other, own_keys, found, buckets), _in_buckets(mine, own_keys, found, buckets)
    renamed = other.toDF(*[f"_a{i}" for i in range(len(cols))]).distinct()
    met = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(cols, renamed.columns, strict=True)]
    differing = mine.join(renamed, reduce(lambda x, y: x & y, met), "left_anti")
    return reduce(DataFrame.unionByName, [differing, *never]).select("_row.*")
