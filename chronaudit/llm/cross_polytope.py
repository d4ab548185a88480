"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

A vector is turned by rounds of random sign changes and fast Hadamard transforms; its hash
is the axis, with its sign, that it then lies nearest to. Several such hashes make the
bucket of a table. In every table a vector lies in its own bucket and is also shown, as a
probe, in those it came closest to missing. Vectors that meet, one of them at home, are
compared by their cosine.

Buckets are dealt out without vectors, with a short projection of each in small integers. A
projection brings no two vectors further apart, so a pair whose projections are too far from
each other has too small a cosine; only members that are left with a partner are joined
with their vectors and compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.llm.common import in_files
from chronaudit.llm.components import components

TABLES, HASHES, PROBES, ROUNDS = 6, 2, 2, 3
SEED = 20
#: Members of a bucket that are compared as one block; larger buckets become pairs of blocks.
BLOCK = 2048
#: Numbers of a projection, each an integer of one byte.
SKETCH = 16
#: Rows of whole buckets that are compared in one go, by sketches and by vectors, and cells held at once.
SKETCH_ROWS, VECTOR_ROWS, CELLS = 16_384, 4096, 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in as many steps as the width has doublings."""
    n, width = x.shape
    x, step = x.copy(), 1
    while step < width:
        parts = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x


def signatures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home buckets (rows, tables) and probed ones (rows, tables, probes) of unit vectors."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    signs = np.random.default_rng([SEED, dim]).choice([-1.0, 1.0], size=(TABLES, HASHES, ROUNDS, width))
    home = np.zeros((n, TABLES), dtype=np.int64)
    probes = np.zeros((n, TABLES, PROBES), dtype=np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best, second, gap = [], [], []
        for h in range(HASHES):
            turned = padded
            for r in range(ROUNDS):
                turned = hadamard(turned * signs[t, h, r]) / np.sqrt(width)
            size = np.abs(turned)
            first = size.argmax(axis=1)
            rest = size.copy()
            rest[rows, first] = -1.0
            top = np.stack((first, rest.argmax(axis=1)), axis=1)
            axis = 2 * top + (turned[rows[:, None], top] < 0)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(size[rows, top[:, 0]] - size[rows, top[:, 1]])
        base = 2 * width
        for h in range(HASHES):
            home[:, t] = home[:, t] * base + best[h]
        changed = np.stack(
            [home[:, t] + (second[h] - best[h]) * base ** (HASHES - 1 - h) for h in range(HASHES)], axis=1)
        order = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")[:, :PROBES]
        probes[:, t] = np.take_along_axis(changed, order, axis=1)
    return home, probes


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large numbers would overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketches(x: np.ndarray) -> np.ndarray:
    """The first numbers of a turn of unit vectors, times 127 and rounded (rows, SKETCH)."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    turned = np.zeros((n, width))
    turned[:, :dim] = x
    for signs in np.random.default_rng([SEED, dim, 1]).choice([-1.0, 1.0], size=(ROUNDS, width)):
        turned = hadamard(turned * signs) / np.sqrt(width)
    out = np.zeros((n, SKETCH), dtype=np.int8)
    out[:, : min(width, SKETCH)] = np.rint(127 * turned[:, :SKETCH])
    return out


def sketch_reach(least: float) -> float:
    """The largest squared distance between sketches of unit vectors with that cosine or more.

    Rounding moves each number by half at most, and so a sketch by half the root of their number.
    """
    return float(np.floor((127 * np.sqrt(max(0.0, 2 - 2 * least)) + np.sqrt(SKETCH)) ** 2 + 1e-3))


def _packed(kind: str):
    """Vectors as bytes; null where they are null or zero or hold what is not a finite number."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten().cast(pa.float32() if kind == "<f4" else pa.float64(), safe=False)  # none of null lists
            usable = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(kind, copy=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate(([0], np.cumsum(~(usable & np.isfinite(values)))))
            some = np.concatenate(([0], np.cumsum(values != 0)))
            good = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
            out = [values[e - n : e].tobytes() if g else None for e, n, g in zip(ends, sizes, good, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "vector"])

    return pack


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(rows.reshape(-1)))


_PLACES = "node bigint, label string, size int, homes array<bigint>, probes array<bigint>, sketch binary"


def _places(kind: str):
    """The home buckets of each vector, those it is shown in (table by table), and its sketch."""

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                for at in range(0, own.num_rows, 1024):
                    rows = own.slice(at, 1024)
                    x = _unit(rows.column("vector").to_pylist(), kind)
                    home, probes = signatures(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("node"), rows.column("label"), pa.array(np.full(len(x), size), pa.int32()),
                            _fixed(home), _fixed(probes.reshape(len(x), -1)),
                            pa.array([v.tobytes() for v in sketches(x)], pa.binary()),
                        ],
                        ["node", "label", "size", "homes", "probes", "sketch"])

    return spell


def _close_pairs(
    points: np.ndarray, bar: np.ndarray, begins: np.ndarray, home: np.ndarray, side: np.ndarray, across: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs p < q of rows of one group, one of them at home, whose product reaches the sum of their bars.

    ``begins`` are the groups' first rows. In groups marked ``across`` only pairs of unlike sides
    count. Groups of one size are compared together; large ones a part of their rows at a time.
    """
    sizes = np.diff(np.append(begins, len(points)))
    for m in np.unique(sizes[sizes > 1]):
        own = begins[sizes == m]
        many = max(1, CELLS // int(m * m))
        for at in range(0, len(own), many):
            rows = own[at : at + many, None] + np.arange(m)
            for low in range(0, m, max(1, CELLS // int(m))):
                part = rows[:, low : low + max(1, CELLS // int(m))]
                close = points[part] @ points[rows].transpose(0, 2, 1) >= bar[part][:, :, None] + bar[rows][:, None, :]
                close &= home[part][:, :, None] | home[rows][:, None, :]
                close &= rows[:, None, :] > part[:, :, None]
                close &= (side[part][:, :, None] != side[rows][:, None, :]) | ~across[part][:, :1, None]
                g, p, q = np.nonzero(close)
                if len(g):
                    yield part[g, p], rows[g, q]


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str], least_rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in runs of whole groups, with the first row of each group."""
    held: list[pa.RecordBatch] = []

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        new[:1] = True
        for c in keys:
            col = rows.column(c).combine_chunks()
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < least_rows:
            continue
        rows = pa.Table.from_batches(held)
        firsts = begins(rows)
        if len(firsts) > 1:  # the last group may go on
            yield rows.slice(0, int(firsts[-1])).combine_chunks(), firsts[:-1]
            rows = rows.slice(int(firsts[-1]))
        held = rows.to_batches()
    if sum(x.num_rows for x in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, begins(rows)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _flags(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flags = _numbers(rows, "flags")
    return (flags & 1) > 0, (flags & 2) > 0, _numbers(rows, "i") != _numbers(rows, "j")


_GROUP = ["code", "i", "j"]


def _partnered(least: float):
    """Members of buckets whose sketch leaves them a partner there."""
    reach = sketch_reach(least)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _runs(batches, _GROUP, SKETCH_ROWS):
            data = rows.column("sketch").to_pylist()
            points = np.frombuffer(b"".join(data), dtype=np.int8).reshape(len(data), SKETCH).astype(np.float32)
            # |a - b|^2 <= reach just if a b >= the sum of these; all are exact in single precision
            bar = (points * points).sum(axis=1) / 2 - np.float32(reach / 4)
            kept = np.zeros(len(points), dtype=bool)
            for p, q in _close_pairs(points, bar, begins, *_flags(rows)):
                kept[p] = kept[q] = True
            for out in rows.select([*_GROUP, "node", "flags"]).filter(pa.array(kept)).to_batches():
                yield out

    return check


def _first_meeting(home_a: np.ndarray, probes_a: np.ndarray, home_b: np.ndarray, probes_b: np.ndarray) -> np.ndarray:
    """The least bucket in which pairs of vectors meet, one of them at home."""
    none = np.iinfo(np.int64).max
    same = home_a == home_b
    a_home = same | (probes_b == home_a[:, :, None]).any(axis=2)
    b_home = same | (probes_a == home_b[:, :, None]).any(axis=2)
    return np.minimum(np.where(a_home, home_a, none), np.where(b_home, home_b, none)).min(axis=1)


def _join_roots(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Make the parts that pairs connect one, under the least of their rows."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _linker(least: float, kind: str):
    """Links counted here of each member, and the first member of its part of the links."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in _runs(batches, [*_GROUP, "size", "label"], VECTOR_ROWS):
            sizes = _numbers(table, "size")
            group = np.zeros(table.num_rows, dtype=np.int64)
            group[firsts] = 1
            group = np.cumsum(group)
            for size in np.unique(sizes):
                mask = sizes == size
                rows = table.filter(pa.array(mask)).combine_chunks()
                begins = np.flatnonzero(np.diff(group[mask], prepend=-1))
                x = _unit(rows.column("vector").to_pylist(), kind)
                code, weight = _numbers(rows, "code"), _numbers(rows, "n")
                homes = np.array(rows.column("homes").to_pylist(), dtype=np.int64)
                probes = np.array(rows.column("probes").to_pylist(), dtype=np.int64).reshape(len(x), TABLES, PROBES)
                links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
                linked = np.zeros(len(x), dtype=bool)
                for p, q in _close_pairs(x, np.full(len(x), least / 2), begins, *_flags(rows)):
                    for at in range(0, len(p), 65_536):
                        a, b = p[at : at + 65_536], q[at : at + 65_536]
                        here = _first_meeting(homes[a], probes[a], homes[b], probes[b]) == code[a]
                        a, b = a[here], b[here]
                        np.add.at(links, a, weight[b])
                        np.add.at(links, b, weight[a])
                        linked[a] = linked[b] = True
                        _join_roots(root, a, b)
                if linked.any():
                    nodes = _numbers(rows, "node")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[linked]), pa.array(links[linked]), pa.array(nodes[root[linked]])], ["node", "links", "root"])

    return link


def near_vectors(
    vectors: DataFrame, least_cosine: float = 0.98,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per input row: the id, n_links, component_id and kept.

    Vectors are linked where their labels are equal and not null, their lengths equal, and
    the cosine in double precision reaches ``least_cosine``; of the pairs that do, those
    that meet in a bucket are found (tests measure the share). ``n_links`` counts the other
    rows linked directly, ``component_id`` is the least id reachable, the own included, and
    ``kept`` marks the row whose id that is. Null, empty and zero vectors, and those that
    hold null or a number that is not finite, link with nothing, nor do rows without a
    label. Rows with the same label and vector are one class and compared once. Repeated ids
    are rows of their own; a null id is never the least. An empty table gives no rows. Other
    columns are not read.

    A bucket of many vectors becomes pairs of blocks, each a group of its own; what leaves
    a group is a row for each of its members, not for each of its pairs. A pair counts in the
    first bucket, by number, in which it meets.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("embedding"))
    packed = rows.mapInArrow(_packed(kind), "id bigint, label string, vector binary")
    # numbers of rows hold for good once they are written
    named = in_files(
        packed.withColumn("node", F.monotonically_increasing_id()).withColumn("class", F.when(
            F.col("label").isNotNull() & F.col("vector").isNotNull(),
            F.unhex(F.sha2(F.concat(F.encode(F.concat("label", F.lit("\0")), "UTF-8"), F.col("vector")), 256)))),
        "vectors")
    classes = in_files(
        named.filter("class is not null").groupBy("class")
        .agg(F.min("node").alias("node"), F.min("id").alias("first"), F.count("*").alias("n")),
        "vector-classes")

    def bucket(label: str, size: str, place: str) -> F.Column:
        """Numbers of buckets; a table's number is told by the position of the place."""
        per = 1 if place == "homes" else PROBES
        return F.transform(place, lambda x, i: F.xxhash64(label, size, F.floor(i / per).cast("int"), x))

    spelled = named.join(classes.select("node"), "node", "left_semi").select("node", "label", "vector")
    places = in_files(
        spelled.mapInArrow(_places(kind), _PLACES)
        .select("node", "size", bucket("label", "size", "homes").alias("homes"),
                bucket("label", "size", "probes").alias("probes"), "sketch"),
        "vector-places")
    entries = places.select("node", "sketch", F.explode(F.concat(
        F.transform(F.array_distinct("homes"), lambda x: F.struct(x.alias("code"), F.lit(1).alias("home"))),
        F.transform(F.array_except("probes", "homes"), lambda x: F.struct(x.alias("code"), F.lit(0).alias("home"))),
    )).alias("at")).select("at.code", "at.home", "node", "sketch")
    large = in_files(
        entries.groupBy("code").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
        .select("code", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")),
        "large-buckets")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = (
        entries.join(large, "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select(*_GROUP, "node", (F.col("home") + F.when(F.col("block") > F.col("i"), 2).otherwise(0)).alias("flags"), "sketch")
    )
    dealt = cells.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    partnered = in_files(
        dealt.mapInArrow(_partnered(least_cosine), "code bigint, i int, j int, node bigint, flags int"), "vector-partners")
    members = (
        partnered.join(named.select("node", "label", "vector"), "node")
        .join(places.select("node", "size", "homes", "probes"), "node").join(classes.select("node", "n"), "node")
    )
    dealt = members.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "size", "label")
    links = in_files(dealt.mapInArrow(_linker(least_cosine, kind), "node bigint, links bigint, root bigint"), "vector-links")

    roots = in_files(components(links.select("node", "root")), "vector-roots")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    member = (
        classes.join(roots, "node", "left").join(counted, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    heads = in_files(member.groupBy("root").agg(F.min("first").alias("head")), "vector-heads")
    found = in_files(
        member.join(heads, "root").select("class", "head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")),
        "vector-members")
    return (
        named.select("id", "class").join(found, "class", "left")
        .withColumn("component_id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("head")))
        .select(
            F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
