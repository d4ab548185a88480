"""SimHash near-duplicates, found with a pigeonring filter.

The 64 bits are cut into one segment more than the bits that may differ. Going round the
segments as on a ring, two fingerprints within that distance have a segment from which on
every chain of consecutive segments keeps to its share of the distance: none differ in the
first, one bit at most in the first two, and so on round the ring. The first two links of
that chain are an equi-join: the first segment is the same, and so is one half of the
second. The longer chains are tested on the pairs that meet, before the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from chronaudit.llm.common import byte_slices, in_files, text_or_empty
from chronaudit.llm.components import components

BITS = 64
SEED = 42
#: Buckets of more fingerprints than this are resolved by common neighbours, not pair by pair.
PAIRED_BUCKET = 64
SLICE_BYTES = 4 << 20
HASHES_AT_ONCE = 1 << 16


def fingerprint(raw: bytes, shingle: int) -> int:
    """The SimHash of a text in UTF-8: the bits that over half of its shingles' hashes have."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))  # noqa: B905
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id and fp, the fingerprint as a signed long, for every row."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, "text", SLICE_BYTES):
            found = np.array([fingerprint(x, shingle) for x in rows.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(compute, "id bigint, fp bigint")


def _mask(begin: int, end: int) -> int:
    return (1 << end) - (1 << begin)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Ring:
    """The segments of the ring, the keys of the equi-join and the masks of the longer chains."""

    def __init__(self, max_bits: int):
        if not 1 <= max_bits <= 3:
            raise ValueError("max_bits must be 1, 2 or 3")
        m = max_bits + 1
        cuts = [BITS * i // m for i in range(m + 1)]
        segments = list(zip(cuts, cuts[1:]))  # noqa: B905
        self.keys: list[int] = []
        #: for each number of links, the masks of the chains by key
        self.chains: dict[int, list[int]] = {n: [] for n in range(2, m + 1)}
        self.allowed = {n: n * max_bits // m for n in self.chains}
        for i, (begin, end) in enumerate(segments):
            low, high = segments[(i + 1) % m]
            middle = (low + high) // 2
            for half in ((low, middle), (middle, high)):
                self.keys.append(_mask(begin, end) | _mask(*half))
                for n, masks in self.chains.items():
                    masks.append(sum(_mask(*segments[(i + k) % m]) for k in range(n)))


def _literals(masks: list[int]) -> F.Column:
    return F.array(*[F.lit(_signed(x)).cast("bigint") for x in masks])


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links between distinct fingerprints (column fp) that connect all within ``max_bits``.

    Every link returned is within the distance. Where few share a key all of their links are
    returned. Where many do, in groups of near copies, links go to the least fingerprint that
    shares a neighbour: two fingerprints are within the distance just if they have a common
    neighbour at half of it, so those links connect the same ones, in numbers that grow with
    the group and not with its square.
    """
    ring = Ring(max_bits)
    masks = _literals(ring.keys)
    keyed = distinct.select(
        "fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("slot", "key")
    )
    sizes = in_files(keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    shared = in_files(
        keyed.join(sizes, ["slot", "key"]).select("slot", "key", "fp", (F.col("n") > PAIRED_BUCKET).alias("many")), "buckets"
    )

    few = shared.filter(~F.col("many")).drop("many")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    within = [
        F.bit_count(apart.bitwiseAND(F.element_at(_literals(chain), F.col("a.slot") + 1))) <= ring.allowed[n]
        for n, chain in ring.chains.items()  # the last chain is the whole ring
    ]
    met = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for test in within:
        met = met & test
    pairs = few.alias("a").join(few.alias("b"), met).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    inner, outer = max_bits // 2, max_bits - max_bits // 2
    flips = [sum(1 << b for b in bits) for n in range(outer + 1) for bits in combinations(range(BITS), n)]
    outside = F.filter(_literals(flips), lambda x: x.bitwiseAND(F.element_at(masks, F.col("slot") + 1)) == 0)
    spread = (
        shared.filter("many")
        .select("slot", "key", "fp", F.explode(outside).alias("flip"))
        .withColumn("neighbour", F.col("fp").bitwiseXOR(F.col("flip")))
        .withColumn("near", F.bit_count("flip") <= inner)
    )
    place = Window.partitionBy("slot", "key", "neighbour")
    starred = spread.select(
        "fp", "near", F.min("fp").over(place).alias("least"),
        F.min(F.when(F.col("near"), F.col("fp"))).over(place).alias("least_near"),
    )
    stars = starred.select("fp", F.explode(F.array(F.when(F.col("near"), F.col("least")), F.col("least_near"))).alias("other"))
    return pairs.unionByName(stars.filter("other < fp").select(F.col("other").alias("a"), F.col("fp").alias("b"))).distinct()


def _members(named: DataFrame, max_bits: int) -> DataFrame:
    """Each fingerprint with the least id of its rows (first) and the fingerprint that stands for its component (root)."""
    classes = in_files(named.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = in_files(components(links(classes.select("fp"), max_bits)), "roots")
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return in_files(joined.withColumn("root", F.coalesce("root", "fp")), "members")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id, the fingerprint (16 hexadecimal digits) and component_id.

    Documents are linked where fingerprints differ in ``max_bits`` bits or fewer;
    ``component_id`` is the least id reachable over links, the row's own included. Text is
    compared by words between ASCII white space, A-Z in lower case. Texts without words,
    null ones among them, have the fingerprint zero and are linked like any other. Texts
    with fewer words than a shingle have one shingle of them all. Rows of one fingerprint
    are one node, so exact copies make no links. A null id is never the least one; a
    component of null ids only has a null component_id. Repeated ids are rows of their own.
    An empty table gives no rows. Texts count whole, however long. Other columns are not read.
    """
    named = in_files(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    member = _members(named, max_bits)
    heads = in_files(member.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
    found = in_files(member.join(heads, "root").select("fp", "component_id"), "found")
    return named.join(found, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, with all its columns: that with the least id, null ids last.

    Of rows that share that id, those with the least fingerprint stay, and of these the one with
    the least digest of all its columns, so reruns agree. Whole rows are shuffled once, one
    for each id and fingerprint from a task. Null, empty and very long texts are compared as
    ``near_duplicates`` says; columns may have any names; an empty table gives no rows.
    """
    named = in_files(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    member = _members(named, max_bits)
    least = F.min(F.struct(F.col("first").isNull().alias("last"), "first", "fp")).alias("kept")
    taken = {c.lower() for c in docs.columns}
    fp_name, key_name = (next(n for n in (f"{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("fp_", "key_"))

    def key(doc_id: F.Column, fp: F.Column) -> F.Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(fp))

    keepers = in_files(
        member.groupBy("root").agg(least).select(key(F.col("kept.first"), F.col("kept.fp")).alias(key_name)), "keepers")

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, text_col, SLICE_BYTES):
            found = [fingerprint((x or "").encode(), shingle) for x in rows.column(text_col).to_pylist()]
            found = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*rows.columns, found], [*rows.schema.names, fp_name])

    tagged = docs.mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField(fp_name, T.LongType())]))
    tagged = tagged.withColumn(key_name, key(F.col(id_col).cast("bigint"), F.col(fp_name)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = tagged.groupBy(key_name).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(fp_name))
    return one.join(keepers, key_name, "left_semi").select(f"{fp_name}.*")
