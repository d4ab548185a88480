"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Every document is encoded by both tokenizers; tokens whose bytes overlap are linked. Records
of (pair, document) are partitioned by a radix of the first id and written as sorted runs,
packed with zstandard. Runs are merged k ways with a heap, which counts each pair's documents;
pairs come ordered by their first id, so its highest count is known as soon as its pairs end.
The runs are then streamed past the counts, and each hands back what its documents gain.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.llm.common import byte_slices, in_files
from chronaudit.llm.encoding import PieceEncoder
from chronaudit.llm.pair_index import byte_letters
from chronaudit.llm.piece_merge import BYTE, SPACE, MergeCodec, Vocabulary

SLICE_BYTES = 2 << 20
#: Partitions by the first id; a run has one sorted part for each.
RADIX = 32
#: A run is written when it has so many records, or so many documents (their numbers take 16 bits).
RUN_RECORDS, RUN_DOCS = 1_000_000, 1 << 16
#: Runs that one task merges, about; more are merged in several rounds.
FAN_IN = 64
#: Entries of a run that the merge looks at in one step.
BLOCK = 8192
#: Ids take 20 bits in a pair.
ID_BITS = 20


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest type that holds them all, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, dtype=f"<u{data[0]}").astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


class Aligned(NamedTuple):
    """Some texts aligned: counts and groups of each, and all links in order with the text each is in."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    links: np.ndarray
    link_text: np.ndarray


class Aligner:
    """Aligns the tokens of a byte-level tokenizer (A) and a SentencePiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as file:
            config = json.load(file)
        letters = {x: b for b, x in enumerate(byte_letters())}
        vocab = config["model"]["vocab"]
        if (
            config["model"]["type"] != "BPE" or (config.get("pre_tokenizer") or {}).get("type") != "ByteLevel"
            or config.get("normalizer") or not set(letters) <= set(vocab)
        ):
            raise ValueError("the first tokenizer has to be a byte-level BPE without normalizer")
        known = Vocabulary(b_path)
        self.a, self.b = PieceEncoder(a_path, plain=True), MergeCodec(b_path)
        self.a_sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        self.a_sizes[list(vocab.values())] = [len(x) for x in vocab]
        self.b_sizes = np.array([
            1 if kind == BYTE else len(x.replace(SPACE, " ").encode()) for x, kind in zip(known.pieces, known.kinds, strict=True)])
        most = max(len(self.a_sizes), len(self.b_sizes))
        if most > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} tokens do not fit the records")
        self.said = [f"{i}{x}" for i in range(most) for x in ",|;"]

    def align(self, texts: Sequence[str]) -> Aligned:
        """Texts that are empty, or not given back byte by byte, have nothing."""
        # B's letter for a space is the one character that it gives back as another
        taken = [x if SPACE not in x else "" for x in texts]
        a_raw, b_raw = self.a.ids([" " + x if x else "" for x in taken]), self.b.encode(taken)
        a, b = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (a_raw, b_raw))
        n_a, n_b = (np.array([len(x) // 4 for x in raw], dtype=np.int64) for raw in (a_raw, b_raw))
        a_text, b_text = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        sizes = [np.bincount(t, table[x], len(texts)) for t, table, x in ((a_text, self.a_sizes, a), (b_text, self.b_sizes, b))]
        if (sizes[0] != sizes[1]).any():
            raise ValueError("the tokenizers do not cover the same bytes")
        if not len(a):
            none = np.zeros(0, dtype=np.int64)
            return Aligned(n_a, n_b, n_a, [""] * len(texts), none, none)
        a_last, b_last = b_ends[np.searchsorted(b_ends, a_ends)] == a_ends, a_ends[np.searchsorted(a_ends, b_ends)] == b_ends
        # between neighbouring ends of either side lies what just one pair of tokens shares
        ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        ends = ends[np.concatenate(([True], ends[1:] != ends[:-1]))]
        at = np.searchsorted(a_ends, ends)
        left, right = a[at], b[np.searchsorted(b_ends, ends)]
        links = (left % RADIX) << 2 * ID_BITS | left << ID_BITS | right
        n_groups = np.bincount(a_text[a_last], minlength=len(texts))
        # groups one after another, in each first A's tokens and then B's, every id with what follows it
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        said = np.empty(len(a) + len(b), dtype=np.int64)
        b_before = np.concatenate(([0], np.cumsum(np.bincount(b_group))))
        a_until = np.cumsum(np.bincount(a_group))
        said[np.arange(len(a)) + b_before[a_group]] = 3 * a + a_last
        said[np.arange(len(b)) + a_until[b_group]] = 3 * b + 2 * b_last
        stops = np.cumsum(n_a + n_b).tolist()
        find = self.said.__getitem__
        groups = ["".join(map(find, said[i:j].tolist()))[:-1] for i, j in zip([0, *stops], stops)]  # noqa: B905
        return Aligned(n_a, n_b, n_groups, groups, links, a_text[at])


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Run:
    """Records of (pair, document) until they are written: radix, A id, B id and number in the run, as one integer."""

    def __init__(self):
        self.name, self.docs, self.records = uuid.uuid4().hex, 0, 0
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, found: Aligned) -> None:
        """The links of some documents; numbers are given in this order."""
        codes, times = np.unique(found.links << 16 | (self.docs + found.link_text), return_counts=True)
        self.codes.append(codes)
        self.times.append(times)
        self.docs += len(found.groups)
        self.records += len(codes)

    def parts(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """For each radix: pairs, their numbers of documents, and for each pair the documents and how often each has it."""
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        order = np.argsort(codes, kind="stable")  # sorted stretches one after another
        codes, times = codes[order], times[order]
        bounds = np.searchsorted(codes, np.arange(RADIX + 1) << (2 * ID_BITS + 16)).tolist()
        for radix, (i, j) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
            if i < j:
                keys, docs = np.unique(codes[i:j] >> 16, return_counts=True)
                yield radix, pack_sorted(keys), pack(docs), pack(codes[i:j] & 0xFFFF), pack(times[i:j])


_RUN = "run string, radix int, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, docs binary, places binary, times binary"


def _spill(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document (radix -1), and the runs' parts, in files."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([
        ("run", pa.string()), ("radix", pa.int32()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("pairs", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])

    def written(run: Run, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        for radix, *blobs in run.parts() if run.records else ():
            fields = {"run": run.name, "radix": radix, **dict(zip(["pairs", "docs", "places", "times"], blobs, strict=True))}
            columns = [pa.array([fields.get(f.name)], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(1, ids)], [*schema.names, "id"])

    def spill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, run, ids = aligner(a_path, b_path), Run(), None
        for part in byte_slices(batches, "text", SLICE_BYTES):
            for at in range(0, part.num_rows, RUN_DOCS // 4):
                some = part.slice(at, RUN_DOCS // 4)
                ids = some.column("id").type
                if run.docs + some.num_rows > RUN_DOCS or run.records >= RUN_RECORDS:
                    yield from written(run, ids)
                    run = Run()
                found = both.align([x or "" for x in some.column("text").to_pylist()])
                first, n = run.docs, some.num_rows
                run.add(found)
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([run.name] * n), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int32)),
                    pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups), pa.array(np.bincount(found.link_text, minlength=n)),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.groups]),
                    nothing, nothing, nothing, nothing, some.column("id")], [*schema.names, "id"])
        if ids is not None:
            yield from written(run, ids)

    return in_files(rows.mapInArrow(spill, f"{_RUN}, id {kind}"), "token-runs")


def merged_blocks(runs: Sequence[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of keys and counts as one: blocks in ascending order, counts of equal keys added up.

    The heap holds the last key of each run's current block. Up to the least of these every
    run has shown all it has, so that stretch of all runs can be added up and given out.
    """
    at = [0] * len(runs)
    heap = [(int(keys[min(BLOCK, len(keys)) - 1]), r) for r, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        fence, _ = heap[0]
        keys, counts = [], []
        for r, (own, n) in enumerate(runs):
            end = at[r] + int(np.searchsorted(own[at[r] : at[r] + BLOCK], fence, side="right"))
            if end > at[r]:
                keys.append(own[at[r] : end])
                counts.append(n[at[r] : end])
                at[r] = end
        while heap and heap[0][0] <= fence:
            _, r = heapq.heappop(heap)
            own = runs[r][0]
            if at[r] < len(own):
                heapq.heappush(heap, (int(own[min(at[r] + BLOCK, len(own)) - 1]), r))
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, place, np.concatenate(counts))
        yield found, total


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each (radix, part) of sorted rows as one run, with the pairs that are best for their A id."""

    def joined(key, runs):
        blocks = list(merged_blocks(runs))
        keys, counts = (np.concatenate(x) for x in zip(*blocks, strict=True))
        first = keys >> ID_BITS
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))
        values = [[key[0]], [key[1]], [pack_sorted(keys)], [pack(counts)], [pack((counts == highest).astype(np.int64))]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["radix", "part", "pairs", "docs", "best"])

    now, runs = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["radix"], row["part"]
            if key != now and runs:
                yield joined(now, runs)
                runs = []
            now = key
            runs.append((unpack_sorted(row["pairs"]), unpack(row["docs"])))
    if runs:
        yield joined(now, runs)


def _counted(runs: DataFrame, n_runs: int) -> DataFrame:
    """One row per radix: its pairs in order, their numbers of documents and which are best."""
    rest = runs.select("radix", F.xxhash64("run").alias("part"), "pairs", "docs")
    while True:
        parts = math.ceil(n_runs / FAN_IN)
        rows = rest.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts))).repartition("radix", "part").sortWithinPartitions("radix", "part")
        done = in_files(rows.mapInArrow(_merge, "radix int, part long, pairs binary, docs binary, best binary"), "pair-counts")
        if parts == 1:
            return done
        rest, n_runs = done.select("radix", "part", "pairs", "docs"), parts


def _sums(places: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    if int(weights.sum()) < 2**53:
        return np.bincount(places, weights, n).astype(np.int64)
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, places, weights)
    return total


def _gains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run's part, what its documents gain. The counts of a part come ahead of its runs."""
    keys = counts = best = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["run"] is None:
                keys, counts, best = unpack_sorted(row["pairs"]), unpack(row["docs"]), unpack(row["best"])
                continue
            at = np.repeat(np.searchsorted(keys, unpack_sorted(row["pairs"])), unpack(row["docs"]))
            places, times = unpack(row["places"]), unpack(row["times"])
            n = int(places.max()) + 1
            blobs = [pack(_sums(places, times * best[at], n)), pack(_sums(places, times * counts[at], n))]
            yield pa.RecordBatch.from_arrays([pa.array([row["run"]]), *[pa.array([x], pa.binary()) for x in blobs]], ["run", "best", "total"])


def _by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gains of sorted runs, added up over their parts: a row for each place in the run."""

    def rows(run, best, total):
        n = int(np.flatnonzero(total).max(initial=-1)) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([run] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(best[:n]), pa.array(total[:n])],
            ["run", "place", "n_best", "count_sum"])

    now = best = total = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["run"] != now:
                if now is not None:
                    yield rows(now, best, total)
                now, best, total = row["run"], np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
            for sums, new in ((best, unpack(row["best"])), (total, unpack(row["total"]))):
                sums[: len(new)] += new
    if now is not None:
        yield rows(now, best, total)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def token_agreement(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: how its tokens align, and how far it links tokens as the corpus mostly does.

    The text with a space before it is encoded by the byte-level BPE ``a_path`` and the text by
    the SentencePiece model ``b_path`` (which adds that space); special strings are plain
    text. n_a, n_b and n_groups count tokens and groups (cut where both end a token);
    n_links counts pairs of token occurrences whose bytes overlap; a pair of ids counts
    in how many rows of the corpus it is linked; n_best counts links whose count is the highest of
    their A id (ties included); count_sum adds the counts of all links. groups_sha256 digests
    the groups as ``align_column`` gives them.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have
    zeros and an empty digest, and count for no pair. Rows that are repeated, or share an id,
    count each for itself; null ids are kept; other columns are not read. Texts count whole,
    however long. An empty table gives an empty table.

    Runs hold about a million records; a task holds one run, or the counts of one radix (bounded by the
    vocabularies) and one part of a run. A pair in every document is spread over all runs.
    """
    spilled = _spill(_texts(docs, id_col, text_col), a_path, b_path)
    rows = spilled.where("radix = -1").select(
        F.col("id").alias(id_col), "run", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = spilled.where("radix >= 0").select("run", "radix", "pairs", "docs", "places", "times")
    n_runs = runs.agg(F.count_distinct("run").alias("n")).first()["n"]
    zero = F.lit(0).cast("long")
    if not n_runs:
        return rows.drop("run", "place").withColumns({"n_best": zero, "count_sum": zero})
    counted = _counted(runs, n_runs)
    salts = math.ceil(n_runs / FAN_IN)
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int")).withColumn("best", F.lit(None).cast("binary"))
    ahead = counted.select(
        F.lit(None).cast("string").alias("run"), "radix", "pairs", "docs", F.lit(None).cast("binary").alias("places"),
        F.lit(None).cast("binary").alias("times"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "best")
    dealt = ahead.unionByName(salted).repartition("radix", "salt").sortWithinPartitions("radix", "salt", F.col("run").asc_nulls_first())
    gains = dealt.mapInArrow(_gains, "run string, best binary, total binary").repartition("run").sortWithinPartitions("run")
    sums = gains.mapInArrow(_by_document, "run string, place int, n_best long, count_sum long")
    return rows.join(sums, ["run", "place"], "left").drop("run", "place").fillna(0, ["n_best", "count_sum"])


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """One row per pair of ids that is linked anywhere: a_id, b_id, n_docs, and best (highest of its A id).

    Rows and texts count as in ``token_agreement``; nothing linked gives an empty table.
    """
    runs = _spill(docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text")), a_path, b_path).where("radix >= 0")
    counted = _counted(runs, max(1, runs.agg(F.count_distinct("run").alias("n")).first()["n"]))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, low = unpack_sorted(row["pairs"]), (1 << ID_BITS) - 1
                columns = [keys >> ID_BITS & low, keys & low, unpack(row["docs"]), unpack(row["best"]) == 1]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a_id", "b_id", "n_docs", "best"])

    return counted.mapInArrow(spread, "a_id long, b_id long, n_docs long, best boolean")


def align_column(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", out: str = "groups") -> DataFrame:
    """The rows with one more column: the groups of each text, as ``a1,a2|b1;a3|b2,b3`` in decimal ids.

    Empty for texts without tokens (see ``token_agreement``). All rows and columns are kept; a
    column that is already called ``out`` is an error. An empty table gives an empty table.
    """
    if out in docs.columns:
        raise ValueError(f"the rows have a column {out} already")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col, SLICE_BYTES):
            found = aligner(a_path, b_path).align([x or "" for x in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.groups, pa.string())], [*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(align, f"{schema}, `{out}` string")
