"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from chronaudit.llm import piece_merge

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "   ", "    ", "\n", "\t", "\r\n", "\0", "a", "the", "and", "ab", "abc", "in", "ing", "th", "x", "▁", "é", "é",
    "日本", "一", "<s>", "</s>", "<unk>", "<0x41>", "😀", "́", "aaaa", "\xa0", "　", "\x1c", "1234", "==", "--",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return piece_merge.MergeCodec(MODEL)


def packed(ids):
    return [np.array(x, dtype="<u4").tobytes() for x in ids]


def odd_texts():
    draw = random.Random(11)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    for letters in ("ab", " =-", "the an", "abcdefghi 0123_-", "th"):  # many equal and waiting pairs
        texts += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 120))) for _ in range(500)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 0x800), draw.randrange(0x4E00, 0x9000)])) for _ in range(50)) for _ in range(500)]
    return texts


def test_ids_and_texts_of_the_library(codec, library):
    texts = odd_texts()
    wanted = packed(library.encode(texts))
    assert codec.encode(texts) == wanted
    assert codec.encode(texts) == wanted  # from the memo
    assert [codec.decode(x) for x in wanted] == [library.decode(np.frombuffer(x, "<u4").tolist()) for x in wanted]


def test_any_ids_decode(codec, library):
    draw = random.Random(12)
    pool = [lambda: draw.randrange(32000), lambda: draw.randrange(300), lambda: 3 + draw.randrange(0x80, 0x100)]
    for _ in range(4000):
        ids = [draw.choice(pool)() for _ in range(draw.randint(0, 12))]
        assert codec.decode(packed([ids])[0]) == library.decode(ids), ids
    assert codec.decode(packed([[32000, 400]])[0]) == library.decode([400])  # ids outside are left out


@pytest.mark.parametrize("text", [
    "a" * 30_000 + " " * 20_000, " " * 5001, "ab" * 20_000, "日" * 5000, "".join(random.Random(1).choices("abcdefghijk0123", k=50_000)),
    "=" * 4999, "word " * 30_000,
], ids=["aaa", "spaces", "abab", "cjk", "random", "equals", "words"])
def test_long_words(codec, library, text):
    assert codec.encode([text]) == packed([library.encode(text)])


def test_small_vocabulary_merges_in_the_order_of_scores():
    """Words of three letters against the agenda spelled out."""
    codec = piece_merge.MergeCodec(MODEL)
    draw = random.Random(2)
    for _ in range(300):
        symbols = codec._symbols(["".join(draw.choice("anthe") for _ in range(draw.randint(2, 30)))])[0].tolist()
        assert codec._in_order(list(symbols))[0] == slowly(codec, symbols)


def slowly(codec, symbols):
    while True:
        ranks, made = codec._pairs(np.array(symbols[:-1], dtype=np.int64), np.array(symbols[1:], dtype=np.int64))
        if not len(ranks) or ranks.min() == piece_merge.NONE:
            return symbols
        at = int(ranks.argmin())
        symbols = [*symbols[:at], int(made[at]), *symbols[at + 2 :]]


def test_round_trip(odd_docs, sample, library):
    for docs in (odd_docs, sample):
        wanted = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "")
            said = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            wanted.append((r["doc_id"], len(ids), said, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, piece_merge.round_trip(docs, MODEL).collect()), key=str) == sorted(wanted, key=str)


def test_columns(odd_docs, no_docs, library):
    back = piece_merge.decode_column(piece_merge.encode_column(odd_docs, MODEL), MODEL)
    assert back.columns == [*odd_docs.columns, "ids", "decoded"]
    for r in back.collect():
        assert bytes(r["ids"]) == packed([library.encode(r["text"] or "")])[0]
        assert r["decoded"] == (r["text"] or "")
    with pytest.raises(ValueError):
        piece_merge.encode_column(back, MODEL)
    assert piece_merge.round_trip(no_docs, MODEL).collect() == []


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "empty.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        piece_merge.MergeCodec(str(path))
