"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of documents in ascending order of their id, as little-endian unsigned
32-bit integers. Frames end with documents, and only documents longer than a frame are cut.
A skippable frame with the index follows: a checksum, and packed the number of documents, their
ids, whether the id is null, and their numbers of tokens. A skippable frame with the seek table
closes the file: compressed size, content size and checksum of every frame, in the published
seekable format, in which the index is a frame without content. Other readers of the format see
the ids and nothing else.
A reader fetches the table and the index, then only the frames that it needs.

The manifest, a Parquet table beside the files, names the files that count; a task that was
run again leaves files that it does not name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronaudit.llm.common import byte_slices, text_or_empty
from chronaudit.llm.encoding import piece_encoder

#: Fixed values of the seekable format: skippable frame, seek table, descriptor with checksums.
SKIPPABLE, SEEK_TABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The kind of skippable frame that holds the index; any of 0x184D2A50 to 0x184D2A5F may be chosen.
INDEX = 0x184D2A5A

FRAME_BYTES = 256 << 10
SLICE_BYTES = 2 << 20
MANIFEST_SCHEMA = "part int, file string, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.held = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.stream.write(packed)
        self.table.append((len(packed), len(content), _checksum(content)))

    def _flush(self) -> None:
        content = b"".join(self.pending)
        for at in range(0, len(content), self.frame_bytes):
            self._frame(content[at : at + self.frame_bytes])
        self.pending, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self._flush()
        self.pending.append(ids)
        self.held += len(ids)
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)

    def close(self) -> None:
        self._flush()
        named = np.array([0 if x is None else x for x in self.ids], dtype="<i8")
        blank = np.array([x is None for x in self.ids], dtype="u1")
        lengths = np.array(self.lengths, dtype="<u8")
        index = struct.pack("<Q", len(self.ids)) + named.tobytes() + blank.tobytes() + lengths.tobytes()
        packed = struct.pack("<I", _checksum(index)) + self.compressor.compress(index)
        self.stream.write(struct.pack("<II", INDEX, len(packed)) + packed)
        self.table.append((8 + len(packed), 0, _checksum(b"")))
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEK_TABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(rows) + len(foot)) + rows + foot)


class FrameReader:
    """Reads documents of one file from a random-access binary stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        self.unpack = zstandard.ZstdDecompressor()
        stream.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_TABLE or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        stream.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(stream.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.packed_at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.content_at = np.concatenate(([0], np.cumsum(self.table[:, 1])))
        index = self._index(n - 1)
        docs = struct.unpack_from("<Q", index)[0]
        self.ids = np.frombuffer(index, dtype="<i8", count=docs, offset=8)
        self.blank = np.frombuffer(index, dtype="u1", count=docs, offset=8 + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, dtype="<u8", count=docs, offset=8 + 9 * docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.frames_read = 0

    def _index(self, k: int) -> bytes:
        self.stream.seek(int(self.packed_at[k]))
        packed = self.stream.read(int(self.table[k, 0]))
        magic, size, checksum = struct.unpack_from("<III", packed)
        if magic != INDEX or size != len(packed) - 8:
            raise ValueError("no index before the seek table")
        index = self.unpack.decompress(packed[12:])
        if _checksum(index) != checksum:
            raise ValueError("the index does not fit its checksum")
        return index

    def frame(self, k: int) -> bytes:
        """The content of a frame; an error if it does not fit its checksum."""
        self.stream.seek(int(self.packed_at[k]))
        content = self.unpack.decompress(self.stream.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if _checksum(content) != self.table[k, 2]:
            raise ValueError(f"frame {k} does not fit its checksum")
        return content

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """Positions and ids of documents, given by ascending position; other frames stay packed."""
        at, content = -1, b""
        for i in wanted:
            begin, end = int(self.starts[i]) * 4, int(self.starts[i + 1]) * 4
            parts = []
            while begin < end:
                k = int(np.searchsorted(self.content_at, begin, side="right")) - 1
                if k != at:
                    at, content = k, self.frame(k)
                    self.frames_read += 1
                low = begin - int(self.content_at[k])
                parts.append(content[low : low + end - begin])
                begin += len(parts[-1])
            yield i, b"".join(parts)


def _writer(folder: str, tokenizer_path: str, end_id: int | None):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_path, "ids")
        end = b"" if end_id is None else struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        filesystem, place = _filesystem(folder)
        filesystem.create_dir(place, recursive=True)
        with filesystem.open_output_stream(f"{place}/{name}", compression=None) as stream:
            out = FrameWriter(stream)
            for rows in byte_slices(batches, "text", SLICE_BYTES):
                for doc_id, ids in zip(rows.column("id").to_pylist(), encoder.ids(rows.column("text").to_pylist()), strict=True):
                    out.add(doc_id, ids + end)
            out.close()
        known = [x for x in out.ids if x is not None]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()), "file": [name],
                "n_docs": pa.array([len(out.ids)], pa.int64()), "n_tokens": pa.array([sum(out.lengths)], pa.int64()),
                "first_id": pa.array(known[:1] or [None], pa.int64()), "last_id": pa.array(known[-1:] or [None], pa.int64()),
            }
        )

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode whole texts and write their ids, in ascending order of the documents' ids.

    Null ids come first; of rows that share an id, the order is that of a digest of their
    texts, so many rows with one id are spread over files. Null texts count as empty and
    have the end id only; texts count whole, however long. An empty table writes an empty
    manifest. Repeated rows are written each time. Other columns are not read. Rows are dealt out by ranges of the
    id before they are encoded, so nothing is encoded twice to find the ranges.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    manifest = dealt.select("id", "text").mapInArrow(_writer(folder, tokenizer_path, end_id), MANIFEST_SCHEMA)
    manifest.write.mode("errorifexists").parquet(f"{folder}/_manifest")


def _reader(folder: str, with_ids: bool, wanted: frozenset[int] | None = None):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, place = _filesystem(folder)
        for row in (x for batch in batches for x in batch.to_pylist()):
            path = f"{place}/{row['file']}"
            with filesystem.open_input_file(path) as stream:
                reader = FrameReader(stream, filesystem.get_file_info(path).size)
                places = range(len(reader.ids))
                if wanted is not None:
                    places = [i for i in places if not reader.blank[i] and int(reader.ids[i]) in wanted]
                found: list[tuple] = []
                held = 0
                for i, ids in reader.documents(places):
                    doc_id = None if reader.blank[i] else int(reader.ids[i])
                    found.append((doc_id, row["start"] + int(reader.starts[i]), len(ids) // 4, zlib.crc32(ids), ids))
                    held += len(ids) if with_ids else 0
                    if held > SLICE_BYTES or len(found) >= 10_000:
                        yield _batch(found, with_ids)
                        found, held = [], 0
                if found:
                    yield _batch(found, with_ids)

    return read


def _batch(found: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k, _ in zip(zip(*found, strict=True), kinds, names)], names)  # noqa: B905


def read_token_files(
    spark: SparkSession, folder: str, with_ids: bool = False, only: Iterable[int] | None = None
) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` is the number of ids of all documents before it, over all files. ``only``
    picks documents by id (a list for the driver's memory); just their frames are unpacked,
    and only files whose range of ids has one are opened. The running sum over the manifest
    handles one row for each file.
    """
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/_manifest")
    files = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))
    wanted = None
    if only is not None:
        wanted = frozenset(only)
        hits = [F.lit(x).between(F.col("first_id"), F.col("last_id")) for x in sorted(wanted)]
        placed = placed.filter(F.array_contains(F.array(*hits), True)) if hits else placed.limit(0)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return placed.repartitionById(max(1, files), "part").mapInArrow(_reader(folder, with_ids, wanted), schema)
