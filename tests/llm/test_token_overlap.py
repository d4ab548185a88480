"""Alignment of two tokenizers against a plain version with the libraries, and the counting by runs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chronaudit.llm import pair_index, queries, token_overlap
from chronaudit.llm.piece_merge import MergeCodec

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "   ", "\n", "\n  ", "\t", "\0", "a", "the", "'s", "É", "é", "日本", "١٢", "<|endoftext|>", "<s>", "<0x41>", "😀", "́",
    "\xa0", "　", "\r\n", "1234", "...", "word",
]


class Plain:
    """What the contract says, text by text."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        back = {c: b for b, c in enumerate(pair_index.byte_letters())}
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def one(self, text):
        """Groups and links of a text, or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
            return None
        spans = []
        for parts in (a_parts, b_parts):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))  # noqa: B905
        links = [(x, y) for x, (i, j) in zip(a, spans[0]) for y, (k, m) in zip(b, spans[1]) if max(i, k) < min(j, m)]  # noqa: B905
        cuts = sorted({j for _, j in spans[0]} & {m for _, m in spans[1]})
        groups = []
        for start, end in zip([0, *cuts], cuts):  # noqa: B905
            sides = [[str(x) for x, (i, j) in zip(ids, own) if start <= i and j <= end] for ids, own in ((a, spans[0]), (b, spans[1]))]  # noqa: B905
            groups.append("|".join(map(",".join, sides)))
        return len(a), len(b), groups, links

    def table(self, rows):
        found = [(i, self.one(t)) for i, t in rows]
        counts = Counter(pair for _, x in found if x for pair in set(x[3]))
        best = {}
        for (a, _), n in counts.items():
            best[a] = max(best.get(a, 0), n)
        out = []
        for i, x in found:
            if x is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            n_a, n_b, groups, links = x
            out.append((
                i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest()))
        return out, counts, best


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def short(rows):
    """The plain version compares all tokens with all; long texts are tested by themselves."""
    return [(i, t) for i, t in rows if len(t or "") < 3000]


def odd_rows():
    draw = random.Random(4)
    return [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25)))) for i in range(1500)]


def test_against_plain(spark, plain, sample):
    rows = odd_rows() + [(None, "word"), (3, None), (3, "▁ word"), (3, "a word"), (3, "a word"), (None, None), (9, "")]
    rows += short([(r["doc_id"], r["text"]) for r in sample.collect()])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = sorted(plain.table(rows)[0], key=str)
    found = token_overlap.token_agreement(docs, A, B)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == wanted


@pytest.mark.parametrize("records,fan", [(50, 2), (400, 3)])
def test_many_small_runs(spark, plain, monkeypatch, records, fan):
    """Several rounds of merging, and several salts."""
    monkeypatch.setattr(token_overlap, "FAN_IN", fan)
    monkeypatch.setattr(token_overlap, "SLICE_BYTES", 200)
    monkeypatch.setattr(token_overlap, "RUN_RECORDS", records)
    rows = [(i, f"the cat {i % 7} sat on mat {i % 3} and the dog" if i % 3 else "the the the") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    runs = token_overlap._spill(token_overlap._texts(docs, "doc_id", "text"), A, B).where("radix >= 0")
    assert runs.select("run").distinct().count() > fan**2
    found = token_overlap.token_agreement(docs, A, B)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == sorted(plain.table(rows)[0], key=str)


def test_pair_counts(spark, plain):
    rows = odd_rows()[:400]
    _, counts, best = plain.table(rows)
    found = token_overlap.pair_counts(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in found} == dict(counts)
    assert len(found) == len(counts)
    assert all(r["best"] == (r["n_docs"] == best[r["a_id"]]) for r in found)


def test_groups_and_odd_rows(spark, odd_docs, no_docs, plain):
    coded = token_overlap.align_column(odd_docs, A, B)
    assert coded.columns == [*odd_docs.columns, "groups"]
    for r in coded.collect():
        if len(r["text"] or "") < 3000:
            one = plain.one(r["text"])
            assert r["groups"] == (";".join(one[2]) if one else "")
    with pytest.raises(ValueError):
        token_overlap.align_column(coded, A, B)
    assert token_overlap.token_agreement(odd_docs, A, B).count() == odd_docs.count()
    for docs in (no_docs, no_docs.unionByName(spark.createDataFrame([(1, None, "en", "a", 0)], no_docs.schema))):
        rows = token_overlap.token_agreement(docs, A, B).select(COLUMNS).collect()
        assert [tuple(r) for r in rows] == [(1, 0, 0, 0, 0, 0, 0, "")] * docs.count()
        assert token_overlap.pair_counts(docs, A, B).collect() == []


def test_long_texts(spark):
    """Texts that are too long for the plain version: both sides' tokens are still those of the libraries."""
    text = "x" * 50_000 + " " * 5000 + "word " * 20_000 + "日" * 3000
    row = token_overlap.token_agreement(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert (row["n_a"], row["n_b"]) == (len(tokenizer.encode(" " + text).ids), len(model.encode(text)))
    assert row["n_best"] <= row["n_links"] == row["count_sum"]  # one document: every count is one


def test_merging_runs():
    draw = np.random.default_rng(3)
    runs = [(np.unique(draw.integers(0, 50_000, n)), None) for n in (0, 1, 20_000, 30_000, 9000, 3)]
    runs = [(k, draw.integers(1, 9, len(k))) for k, _ in runs]
    blocks = list(token_overlap.merged_blocks(runs))
    assert len(blocks) > 2
    keys = np.concatenate([k for k, _ in blocks])
    assert (np.diff(keys) > 0).all()
    wanted = Counter()
    for k, n in runs:
        wanted.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert dict(zip(keys.tolist(), np.concatenate([n for _, n in blocks]).tolist(), strict=True)) == dict(wanted)
    assert list(token_overlap.merged_blocks([])) == []


@pytest.mark.parametrize("values", [[], [0], [255, 0], [256], [70_000, 3], [2**40]])
def test_packing(values):
    assert token_overlap.unpack(token_overlap.pack(np.array(values, dtype=np.int64))).tolist() == values


def test_sums_beyond_doubles():
    places, weights = np.array([0, 2, 0]), np.array([2**60, 5, 1])
    assert token_overlap._sums(places, weights, 3).tolist() == [2**60 + 1, 0, 5]


def test_vocabularies_are_those_of_the_tokenizers():
    aligner = token_overlap.Aligner(A, B)
    assert int(aligner.b_sizes.max()) == max(len(x) for x in MergeCodec(B).texts)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.queries()["op11_token_overlap"](spark, folder)
    assert set(COLUMNS) <= set(found.columns)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
