"""SentencePiece BPE by merge rounds over flat arrays.

The symbols of many words lie in one array. In every round each word's least pair rank is
found, all its occurrences are merged at once from the left, and the arrays are compacted;
words in which no pair is left drop out. Where a merge makes a pair that comes before the
other occurrences, they wait for the next round. A word is a stretch of characters that no piece
of the vocabulary reaches across, so merging words apart gives what merging whole texts does.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.llm.common import byte_slices
from chronaudit.llm.encoding import PieceMemo

SLICE_BYTES = 2 << 20
#: Longer chunks of text are not remembered.
MEMO_CHARS = 200
#: Words of more symbols whose merges have to wait for each other are finished pair by pair.
LONG_WORD = 500

#: The letter that stands for a space, and what an unknown id decodes to.
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.iinfo(np.int32).max

_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """The pieces of a SentencePiece model file, and its settings as far as they matter here."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        self.pieces, scores, self.kinds = [], [], []
        for piece in [dict(_fields(x)) for n, x in model if n == 1]:
            self.pieces.append(piece[1].decode())
            scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
            self.kinds.append(piece.get(3, NORMAL))
        self.scores = np.array(scores)
        trainer = dict(_fields(next((x for n, x in model if n == 2), b"")))
        normal = dict(_fields(next((x for n, x in model if n == 3), b"")))
        if (
            trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0)
            or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1)
            or any(n == 5 and dict(_fields(x)).get(2) for n, x in model)
            or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        ):
            raise ValueError("a BPE model with byte fallback, a leading space and no other normalisation is needed")


class MergeCodec:
    """Encodes and decodes with a SentencePiece BPE vocabulary (a ``.model`` file)."""

    def __init__(self, path: str):
        known = Vocabulary(path)
        self.count = len(known.pieces)
        normal = {x: i for i, (x, kind) in enumerate(zip(known.pieces, known.kinds, strict=True)) if kind == NORMAL}
        chars = sorted({c for x in normal for c in x})
        # characters that occur in pieces without being one may merge, but end as bytes where they do not
        symbols = normal | {c: self.count + k for k, c in enumerate(c for c in chars if c not in normal)}
        self.first_free = self.count + len(symbols) - len(normal)
        self.char_codes = np.array([ord(c) for c in chars], dtype=np.int64)
        self.char_symbols = np.array([symbols[c] for c in chars], dtype=np.int64)

        order = np.unique(-known.scores, return_inverse=True)[1]
        left, right, ranks, made = [], [], [], []
        for x, i in normal.items():
            for k in range(1, len(x)):
                a, b = symbols.get(x[:k]), symbols.get(x[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(order[i])
                    made.append(i)
        codes = np.array(left, dtype=np.int64) * self.first_free + np.array(right, dtype=np.int64)
        by_code = np.argsort(codes)
        self.pair_codes = np.append(codes[by_code], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(ranks, dtype=np.int64)[by_code], NONE)
        self.pair_made = np.append(np.array(made, dtype=np.int64)[by_code], -1)
        # neighbours within some piece; between all others a text may be cut
        near = {(x[i], x[i + 1]) for x in normal for i in range(len(x) - 1)}
        self.near = np.append(np.sort(np.array([ord(a) << 21 | ord(b) for a, b in near], dtype=np.int64)), -1)
        self.chunked = not any(b == SPACE != a or "\n" in (a, b) for a, b in near)

        self.byte_ids = np.zeros(256, dtype="<u4")
        self.texts: list[bytes] = []
        self.kinds = known.kinds
        self.controls = {i for i, kind in enumerate(known.kinds) if kind == CONTROL}
        for i, (x, kind) in enumerate(zip(known.pieces, known.kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(x[1:-1], 16)] = i
                self.texts.append(bytes([int(x[1:-1], 16)]))
            elif kind == CONTROL:
                self.texts.append(b"")
            else:
                self.texts.append((UNKNOWN_TEXT if kind == UNKNOWN else x.replace(SPACE, " ")).encode())
        self.memo = PieceMemo()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs and the pieces that they make; the rank is NONE where there is none."""
        codes = left * self.first_free + right
        codes[(left >= self.first_free) | (right >= self.first_free)] = -1
        at = np.searchsorted(self.pair_codes, codes)
        found = self.pair_codes[at] == codes
        return np.where(found, self.pair_ranks[at], NONE), np.where(found, self.pair_made[at], -1)

    def _symbols(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of the words one after another, and where none joins the one before."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        symbols = np.where(self.char_codes[at] == codes, self.char_symbols[at], self.first_free + codes)
        pairs = codes[:-1] << 21 | codes[1:]
        cut = np.ones(len(codes), dtype=bool)
        cut[1:] = self.near[np.searchsorted(self.near[:-1], pairs)] != pairs
        starts = np.cumsum([0, *map(len, words)])[:-1]
        cut[starts[starts < len(codes)]] = True
        return symbols, cut

    def merge_words(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers. Spaces are written as their letter."""
        symbol, cut = self._symbols(words)
        n = len(symbol)
        word = np.repeat(np.arange(len(words)), [len(x) for x in words])
        segment, place = np.cumsum(cut), np.arange(n)
        rank, made = np.full(n, NONE, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        joins = np.flatnonzero(~cut[1:]) if n else place
        rank[joins], made[joins] = self._pairs(symbol[joins], symbol[joins + 1])
        out_symbol, out_place = [], []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbol))))
            done = least == NONE
            if done.any():
                out_symbol.append(symbol[done])
                out_place.append(place[done])
                symbol, segment, place, rank, made, least = (x[~done] for x in (symbol, segment, place, rank, made, least))
                if not len(symbol):
                    break
            hits = np.flatnonzero(rank == least)
            # of hits that overlap every second one counts, from the left
            at = np.arange(len(hits))
            fresh = np.concatenate(([True], hits[1:] != hits[:-1] + 1))
            hits = hits[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            early = self._up_to_better(symbol, segment, rank, made, hits)
            if not early.all():
                # a long word in which merges wait for each other would need a round for each
                waits = np.unique(segment[hits[~early]])
                waits = waits[np.bincount(segment)[waits] > LONG_WORD]
                if len(waits):
                    part = np.isin(segment, waits)
                    for one in waits.tolist():
                        own = segment == one
                        symbols, offsets = self._in_order(symbol[own].tolist())
                        out_symbol.append(np.array(symbols, dtype=np.int64))
                        out_place.append(place[own][offsets])
                    symbol, segment, place, rank, made = (x[~part] for x in (symbol, segment, place, rank, made))
                    continue
                hits = hits[early]
            symbol[hits] = made[hits]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hits + 1] = False
            symbol, segment, place, rank, made = (x[keep] for x in (symbol, segment, place, rank, made))
            # the pairs that begin with a merged symbol, and those that end with one
            hits -= np.arange(len(hits))
            changed = np.concatenate((hits, hits[hits > 0] - 1))
            rank[changed], made[changed] = NONE, -1
            changed = changed[changed + 1 < len(symbol)]
            changed = changed[segment[changed] == segment[changed + 1]]
            rank[changed], made[changed] = self._pairs(symbol[changed], symbol[changed + 1])
        if not n:
            return [b""] * len(words)
        place = np.concatenate(out_place)
        order = np.argsort(place)
        place, symbol = place[order], np.concatenate(out_symbol)[order]
        return self._ids(symbol, word[place], len(words))

    def _up_to_better(self, symbol, segment, rank, made, hits) -> np.ndarray:
        """Which of the hits come before any pair that one of them makes: each word's first hits
        up to the first that makes a pair of no higher rank than its own."""
        n = len(symbol)
        new, own = made[hits], rank[hits]
        before, after = np.maximum(hits - 1, 0), np.minimum(hits + 2, n - 1)
        near = np.concatenate(([False], hits[1:] == hits[:-1] + 2))  # the symbol before is merged by then
        left = np.where(near, np.concatenate((new[:1], new[:-1])), symbol[before])
        better = (hits > 0) & (segment[before] == segment[hits]) & (self._pairs(left, new)[0] <= own)
        better |= (hits + 2 < n) & (segment[after] == segment[hits]) & (self._pairs(new, symbol[after])[0] <= own)
        if not better.any():
            return np.ones(len(hits), dtype=bool)
        earlier = np.cumsum(better) - better
        starts = np.concatenate(([True], segment[hits[1:]] != segment[hits[:-1]]))
        return earlier == np.maximum.accumulate(np.where(starts, earlier, 0))

    def _in_order(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """One word's symbols, merged pair by pair with a heap, and at which of the given ones they begin."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, made = self._pairs(np.array(symbols[:-1]), np.array(symbols[1:]))
        waiting = [(r, i, m, symbols[i], symbols[i + 1]) for i, (r, m) in enumerate(zip(ranks.tolist(), made.tolist(), strict=True)) if r != NONE]
        heapq.heapify(waiting)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def add(i: int, j: int) -> None:
            pair = symbols[i], symbols[j]
            if pair not in known:
                r, m = self._pairs(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(m[0])
            if known[pair][0] != NONE:
                heapq.heappush(waiting, (known[pair][0], i, known[pair][1], *pair))

        while waiting:
            _, i, new, first, second = heapq.heappop(waiting)
            j = after[i]
            if symbols[i] != first or j >= n or symbols[j] != second:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                add(i, k)
            if before[i] >= 0:
                add(before[i], i)
        places = [i for i, x in enumerate(symbols) if x >= 0]
        return [symbols[i] for i in places], places

    def _ids(self, symbol: np.ndarray, word: np.ndarray, n_words: int) -> list[bytes]:
        """Symbols to the ids of each word, with characters outside the vocabulary as bytes."""
        lengths = np.ones(len(symbol), dtype=np.int64)
        strange = np.flatnonzero(symbol >= self.count)
        codes = symbol[strange] - self.first_free
        extra = codes < 0  # characters of pieces that are none themselves
        if extra.any():
            back = dict(zip(self.char_symbols.tolist(), self.char_codes.tolist(), strict=True))
            codes[extra] = [back[s] for s in symbol[strange[extra]].tolist()]
        raw = [chr(c).encode() for c in codes.tolist()]
        lengths[strange] = [len(x) for x in raw]
        ids = np.repeat(symbol, lengths).astype("<u4")
        begins = (np.cumsum(lengths) - lengths)[strange].tolist()
        for begin, x in zip(begins, raw, strict=True):
            ids[begin : begin + len(x)] = self.byte_ids[list(x)]
        ends = np.cumsum(np.bincount(word, lengths, minlength=n_words).astype(np.int64)).tolist()
        flat = ids.tobytes()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]  # noqa: B905

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, as the model's own library gives them."""
        cut = []
        for text in texts:
            written = SPACE + text.replace(" ", SPACE) if text else ""
            cut.append(_CHUNKS.findall(written) if self.chunked else [written])
        new = self.memo.missing(set().union(*cut))
        memo = self.memo.now
        memo.update(zip(new, self.merge_words(new), strict=True))
        find = memo.__getitem__
        found = [b"".join(map(find, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > MEMO_CHARS:
                del memo[chunk]
        return found

    def decode(self, ids: bytes) -> str:
        """The text of the ids; ids that the vocabulary lacks are left out."""
        known = [i for i in np.frombuffer(ids, dtype="<u4").tolist() if i < self.count]
        parts = [self.texts[i] for i in known]
        for at, i in enumerate(known):  # one leading space belongs to the encoding
            if self.kinds[i] == NORMAL and parts[at].startswith(b" "):
                parts[at] = parts[at][1:]
                break
            if parts[at]:
                break
        if not self.controls.isdisjoint(known):  # bytes on both sides of one make no character together
            groups = itertools.groupby(zip(known, parts, strict=True), lambda x: x[0] in self.controls)
            return "".join(_decode_loosely(b"".join(x for _, x in group)) for control, group in groups if not control)
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return _decode_loosely(b"".join(parts))


def _decode_loosely(data: bytes) -> str:
    """UTF-8 with one replacement character for every byte that is not part of a character."""
    out, at = [], 0
    while at < len(data):
        size = next((k for k in (1, 2, 3, 4) if _is_character(data[at : at + k])), 0)
        out.append(data[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=2)
def codec(path: str) -> MergeCodec:
    return MergeCodec(path)


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, function) -> DataFrame:
    if out in df.columns:
        raise ValueError(f"the rows have a column {out} already")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, column, SLICE_BYTES):
            values = pa.array(function(rows.column(column).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*rows.columns, values], [*rows.schema.names, out])

    return df.mapInArrow(apply, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def encode_column(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The rows with one more column: the text's ids, as little-endian unsigned 32-bit integers.

    No begin or end ids. Null and empty texts have no ids. Texts count whole, however long;
    rows are worked on in slices of about 2 MB. Every row is kept, as often as it is
    repeated, with all its columns; a column that is already called ``out`` is an error. An
    empty table gives an empty table.
    """
    return _mapped(df, text_col, out, T.BinaryType(), pa.binary(), lambda v: codec(model_path).encode([x or "" for x in v]))


def decode_column(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with one more column: the text that the ids stand for (empty for null ids).

    Bytes that make no character become U+FFFD each. Otherwise as ``encode_column``.
    """
    return _mapped(df, ids_col, out, T.StringType(), pa.string(), lambda v: [codec(model_path).decode(x or b"") for x in v])


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, and digests of the decimal ids and of the decoded text.

    Null texts count as empty: no ids, and the digest of nothing. Texts count whole, however
    long. Other columns are not read; repeated rows, repeated ids and null ids are kept. An
    empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def there_and_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(model_path)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            ids = both.encode([x or "" for x in part.column("text").to_pylist()])
            said = [",".join(map(str, np.frombuffer(x, dtype="<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
                    pa.array([hashlib.sha256(both.decode(x).encode()).hexdigest() for x in ids]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(there_and_back, schema).withColumnRenamed("id", id_col)
