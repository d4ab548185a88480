"""Token counts, token files and pair-index BPE against the libraries themselves."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronaudit.llm import encoding, pair_index, token_counts, token_files
from chronaudit.llm.common import scratch_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\xa0", "　", "\x1c", "\0", "a", "the", "'s", "'ll", "I'm", "É", "é", "Σ", "İ", "ß",
    "日本", "١٢", "12", "½", "!!", "...", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "😀", "́", "aaaa", "K",
    "\r\n", " \n ", "_", "-", "\x85",
]


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(3)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(2500)]


@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}


def ids_of(tokenizer, texts):
    return [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_layouts_are_recognised():
    assert encoding.PieceEncoder(BYTES).layout == "spaced"
    assert encoding.PieceEncoder(WORDS).layout == "words"
    assert encoding.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model")).layout == "whole"


def test_pieces_give_the_ids_of_whole_texts(odd_texts, library):
    assert encoding.PieceEncoder(BYTES).ids(odd_texts) == ids_of(library[BYTES], odd_texts)
    wanted = [len(x) for x in library[WORDS].encode_batch(odd_texts, add_special_tokens=False)]
    assert encoding.PieceEncoder(WORDS).counts(odd_texts) == wanted


def test_pair_index_gives_the_ids_of_the_library(odd_texts, library):
    codec = pair_index.PairIndexCodec(BYTES)
    wanted = ids_of(library[BYTES], odd_texts)
    assert codec.encode(odd_texts) == wanted
    decoded = library[BYTES].decode_batch([np.frombuffer(x, "<u4").tolist() for x in wanted], skip_special_tokens=False)
    assert [codec.decode(x) for x in wanted] == decoded


def test_pair_index_knows_every_character(library):
    """The word pattern agrees with the library's on all of Unicode (a share of it here, by a stride)."""
    chars = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} {c} b" for c in chars]
    assert pair_index.PairIndexCodec(BYTES).encode(texts) == ids_of(library[BYTES], texts)


def test_vocabulary_with_prefixes_is_refused():
    with pytest.raises(ValueError):
        pair_index.PairIndexCodec(WORDS)


def test_counts(spark, odd_docs, sample, library):
    for docs in (odd_docs, sample):
        found = token_counts.count_tokens(docs, scratch_path(spark, "cache"), WORDS, collapse_spaces=True)
        texts = [r["text"] or "" for r in docs.collect()]
        ids = [r["doc_id"] for r in docs.collect()]
        counts = [len(x) for x in library[WORDS].encode_batch(texts, add_special_tokens=False)]
        wanted = [(i, len(t.encode()), n, n > 2048) for i, t, n in zip(ids, texts, counts, strict=True)]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def test_counts_come_from_the_cache(spark, sample):
    cache = scratch_path(spark, "cache")
    first = token_counts.count_tokens(sample, cache, WORDS).collect()
    folder = f"{cache}/tokenizer={encoding.tokenizer_digest(WORDS)[:32]}-exact"
    stored = spark.read.parquet(folder)
    texts = {r["text"] or "" for r in sample.collect()}
    assert stored.count() == len(texts)
    again = token_counts.count_tokens(sample.unionByName(sample.limit(3)), cache, WORDS)
    assert again.count() == len(first) + 3
    assert spark.read.parquet(folder).count() == len(texts)  # nothing was encoded again
    # a stored count is believed, so what is joined is the cache
    spark.sql("select unhex(sha2('made up', 256)) as digest, 77L as n_tokens").write.mode("append").parquet(folder)
    made_up = spark.createDataFrame([(1, "made up")], "doc_id bigint, text string")
    assert token_counts.count_tokens(made_up, cache, WORDS).first()["n_tokens"] == 77


@pytest.mark.parametrize("most", [20_000, 3])
def test_few_misses_in_a_warm_cache(spark, sample, library, monkeypatch, most):
    """Cached texts are left out ahead of the shuffle, by a broadcast or a filter; counts are those of the library."""
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", most)
    monkeypatch.setattr(token_counts, "FILTER_WORDS", 1 << 12)
    asked, plain = [], token_counts.may_be_in
    monkeypatch.setattr(token_counts, "may_be_in", lambda *x: asked.append(1) or plain(*x))
    cache = scratch_path(spark, "cache")
    token_counts.count_tokens(sample, cache, WORDS).collect()
    assert not asked  # all are missing, a filter would let all pass
    new = spark.createDataFrame([(10_000 + i, f"new text number {i % 20}") for i in range(40)], "doc_id bigint, text string")
    both = sample.select("doc_id", "text").unionByName(new)
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(both, cache, WORDS).collect()}
    assert bool(asked) == (most == 3)
    rows = both.collect()
    wanted = library[WORDS].encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    assert found == {r["doc_id"]: len(x) for r, x in zip(rows, wanted, strict=True)}
    folder = f"{cache}/tokenizer={encoding.tokenizer_digest(WORDS)[:32]}-exact"
    assert spark.read.parquet(folder).count() == len({r["text"] or "" for r in rows})


def test_no_documents(spark, no_docs):
    assert token_counts.count_tokens(no_docs, scratch_path(spark, "cache"), WORDS).collect() == []
    assert pair_index.round_trip(no_docs, BYTES).collect() == []
    folder = scratch_path(spark, "files")
    token_files.write_token_files(no_docs, folder, BYTES, end_id=2)
    assert token_files.read_token_files(spark, folder).collect() == []


def test_round_trip(odd_docs, sample, library):
    for docs in (odd_docs, sample):
        rows = docs.collect()
        wanted = []
        for r, ids in zip(rows, ids_of(library[BYTES], [r["text"] or "" for r in rows]), strict=True):
            text = library[BYTES].decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
            wanted.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, pair_index.round_trip(docs, BYTES).collect()), key=str) == sorted(wanted, key=str)


def test_columns_of_ids_and_text(odd_docs):
    coded = pair_index.encode_column(odd_docs, BYTES)
    back = pair_index.decode_column(coded, BYTES)
    assert back.columns == [*odd_docs.columns, "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    with pytest.raises(ValueError):
        pair_index.encode_column(coded, BYTES)


def file_rows(docs, tokenizer, end):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = ids_of(tokenizer, [t for _, t in rows])
    return sorted(((i, x + np.array([end], "<u4").tobytes()) for (i, _), x in zip(rows, ids, strict=True)), key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files(spark, sample, odd_docs, library):
    for docs in (sample, odd_docs):
        folder = scratch_path(spark, "files")
        token_files.write_token_files(docs, folder, BYTES, end_id=2)
        found = token_files.read_token_files(spark, folder, with_ids=True).collect()
        found.sort(key=lambda r: r["start"])
        wanted = file_rows(docs, library[BYTES], 2)
        assert [r["doc_id"] for r in found] == [i for i, _ in wanted]
        assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in found) == sorted((str(i), x) for i, x in wanted)
        at = 0
        for r in found:
            assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
            assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
            at += r["n_tokens"]


def test_files_give_single_documents(spark, sample, library):
    folder = scratch_path(spark, "files")
    token_files.write_token_files(sample, folder, BYTES, end_id=2)
    wanted = dict(file_rows(sample, library[BYTES], 2))
    found = token_files.read_token_files(spark, folder, with_ids=True, only=[3, 150, 10**9]).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in found} == {i: wanted[i] for i in (3, 150)}
    assert token_files.read_token_files(spark, folder, only=[]).collect() == []


def test_frames(tmp_path):
    import io

    out = io.BytesIO()
    writer = token_files.FrameWriter(out, frame_bytes=64)
    draw = random.Random(1)
    docs = [draw.randbytes(4 * draw.randint(0, 40)) for _ in range(200)]
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close()
    data = out.getvalue()
    reader = token_files.FrameReader(io.BytesIO(data), len(data))
    assert dict(reader.documents(range(200))) == dict(enumerate(docs))
    reader = token_files.FrameReader(io.BytesIO(data), len(data))
    assert dict(reader.documents([5, 120])) == {5: docs[5], 120: docs[120]}
    assert reader.frames_read <= 8 < len(reader.table)  # other frames stay packed
    import zstandard

    # plain readers see the ids alone: they skip the index and the seek table
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(-1) == b"".join(docs)
    assert reader.table[:, 1].sum() == sum(map(len, docs)) and reader.table[-1, 1] == 0
    at_index = int(reader.packed_at[-2])
    broken = bytearray(data)
    broken[-9 - 12 * 3 + 8] ^= 1  # a checksum in the table
    reader = token_files.FrameReader(io.BytesIO(bytes(broken)), len(broken))
    with pytest.raises(ValueError):
        list(reader.documents(range(200)))
    for at in (at_index, at_index + 4, at_index + 8):  # the kind, the size and the checksum of the index
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.FrameReader(io.BytesIO(bytes(broken)), len(broken))
