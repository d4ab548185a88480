"""Row order within a key: first, last, previous and next row.

A plain window over the key would sort all rows of a hot key in one task. First
and last rows therefore come from aggregates that combine before the shuffle. For
neighbours the rows are dealt out by ranges of key and order, so a hot key lies in as many
ranges as it needs; each range is read in order, and the rows at its ends are stitched to
those of the ranges beside it. Results are the same as with the plain window.

Order columns must identify a row within its key, otherwise ties are arbitrary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _names(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores behind those that are taken (in any case)."""
    used, found = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def _edge_rows(df: DataFrame, keys, order, pick) -> DataFrame:
    keys, order = _names(keys), _names(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    (row,) = free_names(keys, "_row")
    best = df.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])).alias(row))
    return best.select(*keys, f"{row}.*").select(*[F.col(f"`{c}`") for c in df.columns])


def first_per_group(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    return _edge_rows(df, keys, order, F.min)


def last_per_group(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    return _edge_rows(df, keys, order, F.max)


def drop_latest(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """All rows but each key's last one (of ties, all); rows without a key are left out.

    The last place is a maximum, combined before the shuffle; Spark splits a hot key on the
    join of the rows with it.
    """
    keys, order = _names(keys), _names(order)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    (last,) = free_names(df.columns, "_latest")
    latest = df.groupBy(*keys).agg(F.max(place).alias(last))
    return df.join(latest, keys).where(~place.eqNullSafe(F.col(last))).select(*[F.col(f"`{c}`") for c in df.columns])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str] | str,
    date_col: str,
    tie_break: Sequence[str] | str = (),
    carry: Sequence[str] | str = (),
) -> DataFrame:
    """Add the structs ``previous``, ``next`` and ``latest`` to every row.

    Each holds the order columns and the ``carry`` columns of the row before, the
    row after and the last row of the key; previous and next are null at the ends.
    Rows without a key are left out; rows without a date come first. Where the rows have
    columns of these names already, the new ones get underscores behind theirs.
    """
    near = neighbours(df, keys, [date_col, *_names(tie_break)], carry)
    given = ("previous", "next", "latest")
    named = zip(given, free_names(df.columns, *given), strict=True)
    return near.select("row.*", *[F.col(c).alias(n) for c, n in named])


def neighbours(
    df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, carry: Sequence[str] | str = ()
) -> DataFrame:
    """The rows packed as ``row``, with ``previous``, ``next`` and ``latest`` as in ``with_neighbours``.

    Whole rows are shuffled once, into ``spark.sql.shuffle.partitions`` ranges of key and
    order whose bounds Spark samples. A range is read from its end, a batch at a time, so a
    key's latest row is known before its others. Only the ends of ranges are stitched: a row
    for each range, which is what is gathered in one task and broadcast. Rows that agree in
    keys and order lie in one range.
    """
    keys, order, carry = _names(keys), _names(order), _names(carry)
    near = F.struct(*order, *[c for c in dict.fromkeys(carry) if c not in order])
    present = " and ".join(f"`{k}` is not null" for k in keys)
    packed = df.where(present).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(*keys).alias("key"), near.alias("near"))
    place = [F.col("key"), *[F.col("near").getField(c) for c in order]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        packed.repartitionByRange(n, *place)
        .withColumn("range", F.spark_partition_id())
        .sortWithinPartitions(*[c.desc() for c in place])
    )
    kinds = {f.name: f.dataType for f in ranged.schema}

    def schema(**columns: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(c, kind) for c, kind in columns.items()])

    flag, own = T.BooleanType(), kinds["near"]
    rows = ranged.mapInArrow(_reader(ends=False), schema(
        row=kinds["row"], range=kinds["range"], previous=own, next=own, latest=own, at_top=flag, at_bottom=flag, top_key=flag))
    ends = ranged.mapInArrow(_reader(ends=True), schema(
        range=kinds["range"], high_key=kinds["key"], high=own, low_key=kinds["key"], low=own, low_latest=own))

    # the ranges in order; a key's latest row lies in the last of the ranges that it goes on into
    by_range = Window.orderBy("range")
    onward = F.lead("low_key").over(by_range).eqNullSafe(F.col("high_key"))
    whole = F.lead("low_key").over(by_range).eqNullSafe(F.lead("high_key").over(by_range))
    stitched = ends.select(
        "range", "high", "low",
        F.when(F.lag("high_key").over(by_range).eqNullSafe(F.col("low_key")), F.lag("high").over(by_range)).alias("before"),
        F.when(onward, F.lead("low").over(by_range)).alias("after"),
        F.when(~onward, F.col("high")).when(~whole, F.lead("low_latest").over(by_range)).alias("settled"),
    )
    onwards = by_range.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stitched = stitched.select("range", "before", "after", "high", "low", F.first("settled", ignorenulls=True).over(onwards).alias("top"))
    met = (~F.col("at_top") | _same_place("row", "high", order)) & (~F.col("at_bottom") | _same_place("row", "low", order))
    return rows.join(F.broadcast(stitched), "range").select(
        _checked(met).alias("row"),
        F.when(F.col("at_bottom"), F.col("before")).otherwise(F.col("previous")).alias("previous"),
        F.when(F.col("at_top"), F.col("after")).otherwise(F.col("next")).alias("next"),
        F.when(F.col("top_key"), F.col("top")).otherwise(F.col("latest")).alias("latest"),
    )


def _starts():
    """A function for workers, which need nothing of this package for it."""

    def starts(keys):
        """Where a key is not the one before; the first is always taken for a new one."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        same = np.ones(max(len(keys) - 1, 0), dtype=bool)
        for part in keys.flatten():
            a, b = part[1:], part[:-1]
            if pa.types.is_nested(part.type):
                same &= np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], dtype=bool)
                continue
            equal = pc.fill_null(pc.equal(a, b), False)
            if pa.types.is_floating(part.type):
                equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            same &= pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        return np.concatenate((np.ones(min(len(keys), 1), dtype=bool), ~same))

    return starts


def numbered(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, name: str) -> DataFrame:
    """The rows with their number within their key, from 1, in the given order; null is a key.

    Rows are dealt out by ranges of key and order and counted in each; a key that goes on from
    earlier ranges starts behind their rows of it. So a hot key is counted in many tasks. One
    row for each range is gathered in one task and broadcast. Rows that agree in keys and
    order lie in one range, and are numbered in any order.
    """
    keys, order = _names(keys), _names(order)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(*keys).alias("key"))
    place = [F.col("key"), *[F.col("row").getField(c) for c in order]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = packed.repartitionByRange(n, *place).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*place)
    kinds = {f.name: f.dataType for f in ranged.schema}

    def schema(**columns: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(c, kind) for c, kind in columns.items()])

    flag = T.BooleanType()
    rows = ranged.mapInArrow(_counter(ends=False), schema(
        row=kinds["row"], range=kinds["range"], place=T.LongType(), first_key=flag, at_first=flag))
    ends = ranged.mapInArrow(_counter(ends=True), schema(
        range=kinds["range"], head=kinds["row"], first=kinds["key"], last=kinds["key"], held=T.LongType()))
    by_range = Window.orderBy("range")
    goes_on = F.lag("last").over(by_range).eqNullSafe(F.col("first")) & F.lag("range").over(by_range).isNotNull()
    begun = F.when(goes_on & F.col("first").eqNullSafe(F.col("last")), 0).otherwise(1)  # the last key begins in this range
    ends = ends.select("range", "head", "held", goes_on.alias("goes_on"), begun.alias("begun"))
    ends = ends.withColumn("key_no", F.sum("begun").over(by_range))
    ends = ends.withColumn("so_far", F.sum("held").over(Window.partitionBy("key_no").orderBy("range")))
    offsets = ends.select("range", "head", F.when(F.col("goes_on"), F.lag("so_far").over(by_range)).otherwise(0).alias("offset"))
    met = ~F.col("at_first") | _same_place("row", "head", [*keys, *order])
    counted = rows.join(F.broadcast(offsets), "range").withColumn("row", _checked(met))
    return counted.select("row.*", (F.col("place") + F.when(F.col("first_key"), F.col("offset")).otherwise(0)).alias(name))


def _counter(ends: bool):
    """Numbers a range's rows within their keys, or tells its first and last key and how many rows the last one has."""
    starts = _starts()

    def count(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        first = last = None
        held, on_first = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            new = starts(keys if last is None else pa.concat_arrays([last, keys]))
            new = new if last is None else new[1:]
            begins = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            place = np.where(begins < 0, held + np.arange(len(new)), np.arange(len(new)) - begins) + 1
            own = on_first & (np.cumsum(new) <= (first is None))
            if not ends:
                at_first = np.zeros(len(new), dtype=bool)
                at_first[0] = first is None
                columns = [batch.column("row"), batch.column("range"), pa.array(place), pa.array(own), pa.array(at_first)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "range", "place", "first_key", "at_first"])
            first = batch.slice(0, 1) if first is None else first
            last, held, on_first = keys.slice(len(keys) - 1, 1), int(place[-1]), bool(own[-1])
        if ends and first is not None:
            columns = [first.column("range"), first.column("row"), first.column("key"), last, pa.array([held])]
            yield pa.RecordBatch.from_arrays(columns, ["range", "head", "first", "last", "held"])

    return count


def _same_place(a: str, b: str, order: Sequence[str]) -> Column:
    """Whether the structs agree in the order columns."""
    return F.struct(*[F.col(a).getField(c) for c in order]).eqNullSafe(F.struct(*[F.col(b).getField(c) for c in order]))


def _checked(met: Column) -> Column:
    """The row, where the range that it was read in is the one whose ends were read.

    Both are read from one shuffle, which Spark names twice in the plan and runs once
    (``spark.sql.exchange.reuse``). Were it run twice, bounds could differ, and that must not pass unseen.
    """
    said = "ranges differ between two runs of one shuffle; leave spark.sql.exchange.reuse on"
    return F.when(met, F.col("row")).otherwise(F.raise_error(F.lit(said)))


def _reader(ends: bool):
    """Reads a range from its end: its rows with their neighbours within it, or its ends.

    It needs nothing of this package where it runs.
    """

    starts = _starts()

    def ahead(batches):
        """Each batch with the first row of the one after it, if there is one."""
        last = None
        for batch in batches:
            if batch.num_rows:
                if last is not None:
                    yield last, batch.slice(0, 1)
                last = batch
        if last is not None:
            yield last, None

    def joined(parts, column):
        import pyarrow as pa

        return pa.concat_arrays([x.column(column) for x in parts if x is not None])

    def read_rows(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        before = latest = None  # the row that was read last, and the latest row of its key
        top_key = True
        for batch, after in ahead(batches):
            n, shift = batch.num_rows, int(before is not None)
            near = joined((before, batch, after), "near")
            new = starts(joined((before, batch, after), "key"))
            at = np.arange(n) + shift
            run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[at]
            carried = (run == 0) & (shift == 1)
            follows = np.append(~new[1:], False)[at]  # the row read next, the one before it in order, has the same key
            own = top_key & (run == 0)
            known = pa.concat_arrays([near.slice(0, 1) if latest is None else latest, near])
            tops = known.take(pa.array(np.where(carried, 0, run + 1)))
            only = np.zeros(n, dtype=bool)
            first, final = only.copy(), only.copy()
            first[0], final[-1] = shift == 0, after is None
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("range"), near.take(pa.array(at + 1, mask=~follows)),
                    near.take(pa.array(at - 1, mask=new[at])), tops, pa.array(first), pa.array(final), pa.array(own),
                ],
                ["row", "range", "previous", "next", "latest", "at_top", "at_bottom", "top_key"])
            before, latest, top_key = batch.slice(n - 1, 1), tops.slice(n - 1, 1), bool(own[-1])

    def read_ends(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        high = low = latest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(starts(joined((low, batch), "key")))
            near = joined((low, batch), "near")
            if high is None or new[-1] > 0:
                latest = near.slice(int(new[-1]), 1)
            high = batch.slice(0, 1) if high is None else high
            low = batch.slice(batch.num_rows - 1, 1)
        if high is not None:
            yield pa.RecordBatch.from_arrays(
                [high.column("range"), high.column("key"), high.column("near"), low.column("key"), low.column("near"), latest],
                ["range", "high_key", "high", "low_key", "low", "low_latest"])

    return read_ends if ends else read_rows
