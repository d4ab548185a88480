"""Byte-pair encoding by an index from each pair of tokens to all its positions.

The words of many texts are laid out one after another. Every pair that has a merge rank is
indexed with all its positions, and the ranks that occur wait in a heap. The lowest is
applied to all its positions at once; the pairs that this makes are added to the index,
those that it breaks are recognised as stale when their turn comes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.llm.common import byte_slices
from chronaudit.llm.encoding import WHITE_SPACE, PieceMemo, spaced_pieces

SLICE_BYTES = 2 << 20

_W = WHITE_SPACE
#: Fixed value: the word pattern of byte-level tokenizers, white space spelled out.
_WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = iter(range(0x100, 0x200))
    return [letters.get(b) or chr(next(rest)) for b in range(256)]


class PairIndexCodec:
    """Encodes and decodes with a byte-level BPE vocabulary (a ``.json`` tokenizer file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model, before = config["model"], config.get("pre_tokenizer") or {}
        if (
            model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex")
            or before.get("add_prefix_space") or config.get("normalizer") or model.get("ignore_merges")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        ):
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefixes is needed")
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in config.get("added_tokens", [])}
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.size = max([*vocab.values(), *added.values()]) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if len(set(made)) != len(made):
            raise ValueError("two merges make the same token: their order within a word would matter")
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array(made, dtype=np.int64)
        codes = self.left * self.size + self.right
        self.by_code = np.argsort(codes)
        self.codes = codes[self.by_code]
        back = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = {token: np.array([i], dtype="<u4").tobytes() for token, i in added.items()}
        longest = sorted(added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        self.memo = PieceMemo()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; -1 where there is none."""
        codes = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.by_code[at], -1)

    def merge_words(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        token = self.first[flat]
        n = len(token)
        ends = np.cumsum([len(x) for x in words], dtype=np.int64)
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        after[ends[ends > 0] - 1] = -1
        starts = np.concatenate(([0], ends[:-1]))
        before[starts[starts < n]] = -1

        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(places: np.ndarray) -> None:
            """Index the pairs that begin at these places, which are in ascending order."""
            places = places[after[places] >= 0]
            ranks = self._ranks(token[places], token[after[places]])
            known = ranks >= 0
            places, ranks = places[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            begins = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            for rank, part in zip(ranks[begins].tolist(), np.split(places, begins[1:]), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(waiting, rank)

        if n:
            add(np.arange(n, dtype=np.int64))
        while waiting:
            rank = heapq.heappop(waiting)
            parts = index.pop(rank)
            places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[rank], self.right[rank]
            places = places[(token[places] == a) & (after[places] >= 0)]
            places = places[token[after[places]] == b]
            if a == b and len(places) > 1:  # of overlapping pairs the leftmost counts
                kept, taken = [], -1
                for place, second in zip(places.tolist(), after[places].tolist(), strict=True):
                    if place != taken:
                        kept.append(place)
                        taken = second
                places = np.array(kept, dtype=np.int64)
            if not len(places):
                continue
            second = after[places]
            third = after[second]
            token[places], token[second] = self.made[rank], -1
            after[places] = third
            linked = third >= 0
            before[third[linked]] = places[linked]
            ahead = before[places]
            add(np.unique(np.concatenate((places, ahead[ahead >= 0]))))
        live = token >= 0
        kept = token[live].astype("<u4").tobytes()
        bounds = np.concatenate(([0], np.cumsum(live)))[ends].tolist()
        return [kept[4 * i : 4 * j] for i, j in zip([0, *bounds], bounds)]  # noqa: B905

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, as the tokenizer's own library gives them."""
        cut: list[list] = []
        for text in texts:
            if self.cut and any(x in text for x in self.added):
                pieces: list = []
                for part in self.cut.split(text):
                    if part in self.added:
                        pieces.append((part,))  # apart from the same string as a piece
                    else:
                        pieces += spaced_pieces(part)
            else:
                pieces = spaced_pieces(text)
            cut.append(pieces)
        new = self.memo.missing(set().union(*cut))
        memo = self.memo.now
        memo.update({p: self.added[p[0]] for p in new if isinstance(p, tuple)})
        new = [p for p in new if isinstance(p, str)]
        split = [_WORDS.findall(p) for p in new]
        words = list({w for part in split for w in part})
        ids = dict(zip(words, self.merge_words([w.encode() for w in words]), strict=True)) if words else {}
        for piece, part in zip(new, split, strict=True):
            memo[piece] = ids[part[0]] if len(part) == 1 else b"".join([ids[w] for w in part])
        find = memo.__getitem__
        return [b"".join(map(find, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special tokens as their strings; ids not in the vocabulary are left out."""
        known, size = self.bytes, self.size
        return b"".join([known[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < size]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PairIndexCodec:
    return PairIndexCodec(path)


def _mapped(batches: Iterable[pa.RecordBatch], column: str, out: str, kind: pa.DataType, function, limit: int):
    for rows in byte_slices(batches, column, limit):
        values = function(["" if x is None else x for x in rows.column(column).to_pylist()])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, kind)], [*rows.schema.names, out])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_column(df: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The rows with one more column: the text's ids, as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Every row is kept, in whatever number it is
    repeated; a column that is already called ``out`` is an error.
    """
    if out in df.columns:
        raise ValueError(f"the rows have a column {out} already")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _mapped(batches, text_col, out, pa.binary(), codec(tokenizer_path).encode, SLICE_BYTES)

    return df.mapInArrow(encode, _with(df, out, T.BinaryType()))


def decode_column(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with one more column: the text that the ids stand for (empty for null ids)."""
    if out in df.columns:
        raise ValueError(f"the rows have a column {out} already")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(tokenizer_path).decode
        yield from _mapped(batches, ids_col, out, pa.string(), lambda v: [one(x or b"") for x in v], SLICE_BYTES)

    return df.mapInArrow(decode, _with(df, out, T.StringType()))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, and digests of the ids and of the decoded text.

    Null texts count as empty; texts count whole, however long. Other columns are not read;
    repeated rows and null ids are kept. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def there_and_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(tokenizer_path)  # one worker for both ways
        for part in byte_slices(batches, "text", SLICE_BYTES):
            ids = both.encode([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(both.decode(x).encode()).hexdigest() for x in ids]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(there_and_back, schema).withColumnRenamed("id", id_col)
