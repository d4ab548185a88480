"""Secret scans: known forms, and tokens that pass a battery of tests for randomness.

Known forms are found by patterns. Other long tokens are tested: is the alphabet of their
inferred encoding used evenly (chi-squared), do symbols alternate as by chance (runs), and
does a symbol depend on the one before (serial correlation)? A token is added where no test finds
structure in it and it is unlike natural text, judged with the corpus's own letters: either
random symbols explain it far better than pairs of letters as the corpus has them, or it is
much more even than the corpus's characters would be. Which tokens those are is decided over
the whole corpus by the Benjamini-Hochberg procedure in each class of length, where a token
counts once however often it occurs. Parts of a token between slashes, dashes and underscores are
tested as well as the whole, and count where the whole does not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.llm.common import byte_slices, in_files

#: The known forms, the group whose length counts, and the least length.
KNOWN_FORMS = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
ADDED = "random"
KINDS = [*KNOWN_FORMS, ADDED]

#: Encodings in the order in which they are tried.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
NAMES = list(ALPHABETS)
_PLACES = [{c: i for i, c in enumerate(x)} for x in ALPHABETS.values()]

#: Tokens, and parts of tokens, of fewer characters are not tested: too few symbols tell nothing.
LEAST_TOKEN = 20
#: Lower ends of the classes of length within which discoveries are controlled.
LENGTH_CLASSES = (20, 28, 40, 64)
FALSE_DISCOVERIES = 0.01
#: The part of that level that letter pairs have; evenness has the rest.
PAIRS_PART = 0.9
STRUCTURE_LEVEL = 0.001
#: Bins of the p-values: so many for each power of ten, down to 10 to the minus LEAST_POWER.
BINS_PER_POWER, LEAST_POWER = 50, 40
#: Letter pairs: places of bytes, 0 for other than letters; the weight of single letters; and the
#: share of natural letters that need not be like the corpus, which bounds what a pair can say.
PLACES = 27
SINGLE_WEIGHT, UNUSUAL = 26.0, 0.1
SLICE_BYTES = 4 << 20
MASK = "[secret]"

_FORMS = {kind: re.compile(pattern) for kind, (pattern, _, _) in KNOWN_FORMS.items()}
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # where a match of the form that is long enough begins
_LETTERS = np.zeros(256, dtype=np.int64)
for _i in range(1, PLACES):
    _LETTERS[[64 + _i, 96 + _i]] = _i
#: Lower, upper, digit, other; and the bits of a digit and of another symbol among its like.
_CLASS = np.array([0 if 97 <= i < 123 else 1 if 65 <= i < 91 else 2 if 48 <= i < 58 else 3 for i in range(256)])
_OWN_BITS = np.array([0.0, 0.0, math.log2(10), 2.0])
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}={{0,2}}")
#: Long parts of a token between the signs that join words, as in paths and after prefixes.
_PART = re.compile(rf"[A-Za-z0-9+]{{{LEAST_TOKEN},}}={{0,2}}")
_HINTS = ("passw", "secret", "token", "api")

EVIDENCE_SCHEMA = (
    "id bigint, base array<struct<kind:int,start:bigint,end:bigint>>,"
    " tokens array<struct<start:bigint,end:bigint,encoding:int,n:int,chi2:double,structure:double,"
    "bits:double,pairs:array<int>,times:array<int>,digest:binary>>, histogram array<bigint>, pairs array<bigint>"
)


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of the known forms, leftmost and without overlap in each kind."""
    found = []
    lowered = text.lower()
    if any(x in lowered for x in _HINTS):
        found += [(0, m.start(), m.end()) for m in _FORMS["assign"].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _FORMS["access"].finditer(text) if len(m[0]) >= 18]
    found += [(2, m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _below(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def battery(token: str) -> tuple[int, int, float, float] | None:
    """Encoding, length, chi-squared and the level at which structure is found; None if no encoding fits."""
    symbols = token.rstrip("=")
    used = set(symbols)
    encoding = next((i for i, p in enumerate(_PLACES) if used <= p.keys()), None)
    n = len(symbols)
    if encoding is None or n < 2:
        return None
    place = _PLACES[encoding]
    k = len(place)
    at = np.array([place[c] for c in symbols], dtype=float)
    chi2 = float(k / n * (np.bincount(at.astype(int), minlength=k) ** 2).sum() - n)
    # upper tail of chi-squared by the cube-root approximation
    spread = 2 / (9 * (k - 1))
    uneven = _below(-(((chi2 / (k - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread)))
    high = at >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n1 * n2 / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    alternating = _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0
    centred = at - at.mean()
    power = float((centred**2).sum())
    serial = _two_sided(math.sqrt(n) * (float((centred[1:] * centred[:-1]).sum()) / power + 1 / n)) if power else 0.0
    return encoding, n, chi2, min(1.0, 3 * min(uneven, alternating, serial))


def letter_pairs(raw: bytes) -> np.ndarray:
    """How often each place follows each, letters without case; the text begins after another symbol."""
    at = _LETTERS[np.frombuffer(b" " + raw, dtype=np.uint8)]
    return np.bincount(at[:-1] * PLACES + at[1:], minlength=PLACES * PLACES)


def natural_code(token: str, encoding: int) -> tuple[float, list[int], list[int]]:
    """What natural text needs for a token: bits more than random symbols, without letters; and its letter pairs.

    Lower case, upper case, digits and other symbols follow each other at rates learnt within
    the token; digits and other symbols are even. Letters are left to the corpus's pairs.
    """
    raw = token.rstrip("=").encode()
    kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    moves = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16).reshape(4, 4).tolist()
    learnt = sum(math.lgamma(sum(x) + 2) - sum(math.lgamma(n + 0.5) - math.lgamma(0.5) for n in x) for x in moves)
    # any of the four may begin; half of natural tokens are taken to be of one kind throughout
    bits = 3 + float(_OWN_BITS[kinds].sum()) + (learnt / math.log(2) if (kinds != kinds[0]).any() else 0.0)
    counts = letter_pairs(raw)
    pairs = np.flatnonzero(counts)
    pairs = pairs[pairs % PLACES > 0]
    return bits - len(raw) * math.log2(len(ALPHABETS[NAMES[encoding]])), pairs.tolist(), counts[pairs].tolist()


_FIELDS = ("start", "end", "encoding", "n", "chi2", "structure", "bits", "pairs", "times", "digest")


def token_evidence(text: str, known: list[tuple[int, int, int]]) -> list[tuple]:
    """The fields of the long tokens, and of long parts of tokens, that no known span touches."""
    found, i = [], 0
    spans = sorted((s, e) for _, s, e in known)
    for m in _TOKEN.finditer(text):
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        near, at = [], i
        while at < len(spans) and spans[at][0] < m.end():
            near.append(spans[at])
            at += 1
        parts = [(m.start() + x.start(), m.start() + x.end()) for x in _PART.finditer(m[0])]
        for start, end in dict.fromkeys([m.span(), *parts]):
            if any(s < end and e > start for s, e in near):
                continue
            token = text[start:end]
            tested = battery(token)
            if tested:
                digest = hashlib.sha256(token.encode()).digest()[:16]
                found.append((start, end, *tested, *natural_code(token, tested[0]), digest))
    return found


def outermost(tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end of those that lie in no other; a part counts only where its token does not."""
    kept: list[tuple[int, int]] = []
    for start, end in sorted(tokens, key=lambda x: (x[0], -x[1])):
        if not kept or end > kept[-1][1]:
            kept.append((start, end))
    return kept


def _short(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a space for each long token and known span, so these do not make themselves natural."""
    parts, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            parts.append(text[at:max(at, start)])
            at = end
    return " ".join([*parts, text[at:]])


def _evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    token_kind = pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("n", pa.int32()),
        ("chi2", pa.float64()), ("structure", pa.float64()),
        ("bits", pa.float64()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
        ("digest", pa.binary()),
    ]))
    counts_kind = pa.list_(pa.int64())
    names = ["id", "base", "tokens", "histogram", "pairs"]
    histogram = np.zeros(256, dtype=np.int64)
    pairs = np.zeros(PLACES * PLACES, dtype=np.int64)
    for rows in byte_slices(batches, "text", SLICE_BYTES):
        base, tokens = [], []
        for text in rows.column("text").to_pylist():
            text = text or ""
            histogram += np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
            known = known_spans(text)
            base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in known])
            long = token_evidence(text, known)
            tokens.append([dict(zip(_FIELDS, x, strict=True)) for x in long])
            pairs += letter_pairs(_short(text, [x[:2] for x in long] + [x[1:] for x in known]).encode())
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), pa.array(base, base_kind), pa.array(tokens, token_kind),
             pa.nulls(len(base), counts_kind), pa.nulls(len(base), counts_kind)], names)
    yield pa.RecordBatch.from_arrays(
        [pa.array([None], pa.int64()), pa.array([None], base_kind), pa.array([None], token_kind),
         pa.array([histogram.tolist()], counts_kind), pa.array([pairs.tolist()], counts_kind)], names)


def evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans and tested tokens of every row, in files; and for each task a row with its counts."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_files(rows.mapInArrow(_evidence, EVIDENCE_SCHEMA), "secret-evidence")


@dataclass(frozen=True)
class Natural:
    """Mean and variance of chi-squared in natural text: a constant and a share for each symbol; and bits of letter pairs."""

    moments: tuple[tuple[float, float, float, float], ...]
    letters: tuple[float, ...] = ()

    @classmethod
    def of(cls, histogram: np.ndarray, pairs: np.ndarray | None = None) -> Natural:
        found = []
        for alphabet in ALPHABETS.values():
            counts = histogram[[ord(c) for c in alphabet]].astype(float) + 1
            f = counts / counts.sum()
            k, second, third = len(f), float((f**2).sum()), float((f**3).sum())
            found.append((k * (1 - second), k * second - 1, 2 * (k - 1), 4 * k * k * max(0.0, third - second**2)))
        after = np.zeros((PLACES, PLACES)) if pairs is None else pairs.reshape(PLACES, PLACES).astype(float)
        after = after[:, 1:]  # letters, after each place
        single = after.sum(axis=0) + 1
        own = (after + SINGLE_WEIGHT * single / single.sum()) / (after.sum(axis=1, keepdims=True) + SINGLE_WEIGHT)
        bits = np.zeros((PLACES, PLACES))
        bits[:, 1:] = -np.log2((1 - UNUSUAL) * own + UNUSUAL / (PLACES - 1))
        return cls(tuple(found), tuple(bits.ravel().tolist()))

    def p_of_pairs(self, bits: float, pairs: list[int], times: list[int]) -> float:
        """A bound of the chance that natural text is so much likelier as random symbols of some encoding.

        By Markov's inequality a likelihood ratio of r against a model has a chance of 1 / r
        at most under it; the random model is the even mixture of the encodings.
        """
        more = bits + sum(self.letters[x] * t for x, t in zip(pairs, times, strict=True)) - math.log2(len(ALPHABETS))
        return 10.0 ** -min(LEAST_POWER, max(0.0, more * math.log10(2)))

    def p_value(self, encoding: int, n: int, chi2: float) -> float:
        """The chance that natural text of this length is as even as that."""
        base, slope, noise, growth = self.moments[encoding]
        return max(10.0**-LEAST_POWER, _below((chi2 - base - n * slope) / math.sqrt(noise + n * growth)))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTH_CLASSES) - 1


def p_bin(p: float) -> int:
    return int(-math.log10(p) * BINS_PER_POWER)


def controlled(counts: dict[tuple[int, int], int], level: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each class of length the least bin that counts as a discovery; classes without one are left out.

    ``counts`` has the tokens by class and bin; bin -1 holds those with structure. A bin is
    judged by its largest p-value, so no more is discovered than with every single value.
    """
    least = {}
    for group in {g for g, _ in counts}:
        own = {b: n for (g, b), n in counts.items() if g == group}
        total, above = sum(own.values()), 0
        for b in sorted((b for b in own if b >= 0), reverse=True):
            above += own[b]
            if 10 ** (-b / BINS_PER_POWER) <= level * above / total:
                least[group] = b
    return least


@dataclass(frozen=True)
class SecretModel:
    """What the corpus as a whole decides: natural character frequencies and least bins."""

    natural: Natural
    least: dict[int, int]

    def bin_of(self, token: tuple) -> tuple[int, int]:
        _, _, encoding, n, chi2, structure, bits, pairs, times, _ = token
        group = length_class(n)
        if structure < STRUCTURE_LEVEL:
            return group, -1
        even = self.natural.p_value(encoding, n, chi2) / (1 - PAIRS_PART)
        return group, p_bin(min(1.0, even, self.natural.p_of_pairs(bits, pairs, times) / PAIRS_PART))

    def secret(self, token: tuple) -> bool:
        group, b = self.bin_of(token)
        return group in self.least and b >= self.least[group]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans (kind, start, end) of a text, by start and then kind."""
        known = known_spans(text)
        added = [(len(KINDS) - 1, *x) for x in outermost([x[:2] for x in token_evidence(text, known) if self.secret(x)])]
        return sorted(known + added, key=lambda x: (x[1], x[0]))


def _totals(found: DataFrame, column: str, width: int) -> np.ndarray:
    """The sums, place by place, of the counts of all tasks."""
    totals = np.zeros(width, dtype=np.int64)
    sums = found.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        totals[row["at"]] = row["n"]
    return totals


def fit(found: DataFrame) -> SecretModel:
    """The model of a corpus from its evidence; the driver gets the counts of bytes, letter pairs and bins.

    A token counts once, however often it occurs, so copies do not move what is decided.
    """
    start = SecretModel(Natural.of(_totals(found, "histogram", 256), _totals(found, "pairs", PLACES * PLACES)), {})

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged: dict[bytes, tuple[int, int]] = {}
            for tokens in batch.column("tokens").to_pylist():
                for token in tokens:
                    if token["digest"] not in judged:
                        judged[token["digest"]] = start.bin_of(tuple(token[x] for x in _FIELDS))
            groups, bins = ([x[i] for x in judged.values()] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(judged), pa.binary()), pa.array(groups, pa.int32()), pa.array(bins, pa.int32())],
                ["digest", "group", "bin"])

    tested = found.filter(F.size("tokens") > 0).select("tokens")
    distinct = tested.mapInArrow(judge, "digest binary, group int, bin int").groupBy("digest").agg(
        F.min("group").alias("group"), F.min("bin").alias("bin"))
    binned = distinct.groupBy("group", "bin").agg(F.count("*").alias("n"))
    return SecretModel(start.natural, controlled({(r["group"], r["bin"]): r["n"] for r in binned.collect()}))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_assign, n_access, n_hex, base_sha256 and spans.

    ``spans`` lists kind:start:end of the known forms and of the added tokens (kind
    ``random``), by start and then kind, in code points with the end exclusive;
    ``base_sha256`` is the digest of the same list of the known forms alone. Null and empty
    texts have no spans. Rows may repeat and ids be null; other columns are not read. An
    empty table gives no rows. Texts count whole, however long, and are read once; the
    frequencies and the control of false discoveries cover all of them. Tokens and parts of
    fewer than ``LEAST_TOKEN`` characters are not tested.
    """
    found = evidence(docs, id_col, text_col)
    model = fit(found)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in batches:
            out: list[tuple] = []
            for base, tokens in zip(batch.column("base").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                known = [(x["kind"], x["start"], x["end"]) for x in base]
                secret = [(x["start"], x["end"]) for x in tokens if model.secret(tuple(x[f] for f in _FIELDS))]
                added = [(len(KINDS) - 1, *x) for x in outermost(secret)]
                kinds = [x[0] for x in known]
                digest = hashlib.sha256(_named(known).encode()).hexdigest()
                everything = sorted(known + added, key=lambda x: (x[1], x[0]))
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, _named(everything)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    rows = found.filter(F.col("histogram").isNull()).select("id", "base", "tokens")
    return rows.mapInArrow(judge, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with each span, or stretch of spans that overlap, replaced."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], mask]
        at = end
    return "".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their secrets masked in the text; columns, their order and row count stay.

    Null texts stay null and empty ones empty; repeated rows are masked alike; an empty table
    gives no rows. The corpus is read twice: for the model, and to mask.
    """
    model = fit(evidence(docs, id_col, text_col))

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, text_col, SLICE_BYTES):
            at = rows.schema.get_field_index(text_col)
            texts = [None if x is None else masked(x, model.spans(x)) for x in rows.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(
        mask, docs.withColumn(text_col, F.col(text_col).cast("string")).schema
    )
