"""Texts to token ids with public tokenizer files, each distinct piece encoded once.

A tokenizer that never joins tokens across certain places in a text can be asked piece by
piece. Pieces repeat far more often than texts, so a worker keeps the ids of those it has
seen. Two such layouts are recognised from the tokenizer's file; any other tokenizer gets
whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Sequence

import numpy as np

#: Pieces that a worker keeps from now on, beside as many from before; others are encoded again.
MEMO_PIECES = 500_000

#: Pieces that the library is asked for at once, and words that are one text for it.
ASKED_AT_ONCE = 4096
JOINED_AT_ONCE = 1024

#: The characters with the Unicode property White_Space, as a pattern class.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"

#: Fixed value: the character that stands for a space in byte-level vocabularies.
SPACE_LETTER = "Ġ"

#: Fixed value: the pattern of tokenizers whose words exclude white space.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_CHUNKS = re.compile(rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
_LONG_SPACE = re.compile(r"\s\s\s|\s\s\Z")
_ONE_WORD = re.compile(r" \S+").fullmatch


def spaced_pieces(text: str) -> list[str]:
    """Pieces of a text between which a byte-level pattern never joins.

    Such a pattern puts one space before a word to that word, and a run of white space
    less its last character into one token. Runs of three or more, and of two at the end,
    need the pattern; elsewhere every space begins a piece and every line end is one.
    """
    if "\0" in text or _LONG_SPACE.search(text):
        return _CHUNKS.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def tokenizer_digest(path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    with open(path, "rb") as file:
        return hashlib.sha256(library.encode() + b"\0" + file.read()).hexdigest()


def _layout(config: dict) -> str:
    """How texts may be cut: ``spaced``, ``words`` (white space is dropped) or ``whole``."""
    before, normal = config.get("pre_tokenizer") or {}, config.get("normalizer") or {}
    if config.get("truncation") or config.get("padding"):
        return "whole"  # the caller switches these off, but a cut text is not worth the doubt
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
        return "spaced"
    steps = before.get("pretokenizers") or [{}]
    simple = {"NFC", "Lowercase", "Replace"} >= {x.get("type") for x in normal.get("normalizers", [normal])}
    spaces = all(x["pattern"] == {"Regex": r"\s+"} for x in normal.get("normalizers", []) if x["type"] == "Replace")
    if (
        simple and spaces and len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and steps[0].get("pattern") == {"Regex": WORDS_ONLY}
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
    ):
        return "words"
    return "whole"


class PieceMemo:
    """What pieces were encoded as. Once there are many, those not met since the last time go."""

    def __init__(self):
        self.now: dict = {}
        self.old: dict = {}

    def missing(self, pieces: set) -> list:
        """The pieces that have no value; all others can then be found in ``now``."""
        if len(self.now) > MEMO_PIECES:
            self.old, self.now = self.now, {}
        now, old, rest = self.now, self.old, []
        for piece in [p for p in pieces if p not in now]:
            if piece in old:
                now[piece] = old[piece]
            else:
                rest.append(piece)
        return rest


class PieceEncoder:
    """Encodes texts with the tokenizer library, asking it once for each distinct piece.

    No begin, end or added special tokens, truncation or padding. Strings of special tokens
    inside a text are treated as the library does by default; texts that hold one are not
    cut into pieces, since the library looks for them first. With ``plain`` such strings are
    ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.memo, self.leads = PieceMemo(), None
        if path.endswith(".model"):
            import sentencepiece

            self.layout, self.special = "whole", ()
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ask: Callable = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        model.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.layout = _layout(config)
        self.special = () if plain else tuple(x["content"] for x in config.get("added_tokens", []))
        self._ask = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        if self.layout == "spaced":
            self.leads = np.zeros(model.get_vocab_size(), dtype=bool)
            for token, i in model.get_vocab().items():
                self.leads[i] = token.startswith(SPACE_LETTER)

    def _pieces(self, text: str) -> list[str] | list[bytes]:
        if self.layout == "whole" or any(x in text for x in self.special):
            return None
        return spaced_pieces(text) if self.layout == "spaced" else text.encode().split()

    def _apply(self, texts: Sequence[str], ask: Callable, join: Callable) -> list:
        cut = [self._pieces(x) for x in texts]
        new = self.memo.missing(set().union(*[x for x in cut if x is not None]))
        for at in range(0, len(new), ASKED_AT_ONCE):
            part = new[at : at + ASKED_AT_ONCE]
            self.memo.now.update(zip(part, ask(part), strict=True))
        find = self.memo.now.__getitem__
        return [
            ask([text])[0] if pieces is None else join(map(find, pieces))
            for text, pieces in zip(texts, cut, strict=True)
        ]

    def _ask_count(self, pieces: list) -> list[int]:
        return list(map(len, self._ask([x.decode() if isinstance(x, bytes) else x for x in pieces])))

    def _ask_ids(self, pieces: list) -> list[bytes]:
        """The ids of each piece. Pieces that begin with their only space are asked for in one text."""
        if self.leads is None or len(pieces) == 1:
            return [np.array(x, dtype="<u4").tobytes() for x in self._ask(pieces)]
        plain = [x is not None for x in map(_ONE_WORD, pieces)]
        words, parts = list(itertools.compress(pieces, plain)), []
        for at in range(0, len(words), JOINED_AT_ONCE):
            joined = np.array(self._ask(["".join(words[at : at + JOINED_AT_ONCE])])[0], dtype="<u4")
            begins = (4 * np.flatnonzero(self.leads[joined])).tolist()
            raw = joined.tobytes()
            parts += [raw[i:j] for i, j in zip(begins, [*begins[1:], len(raw)])]  # noqa: B905
        of_words = iter(parts)
        others = iter(self._ask([x for x, p in zip(pieces, plain, strict=True) if not p]))
        return [next(of_words) if p else np.array(next(others), dtype="<u4").tobytes() for p in plain]

    def counts(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text."""
        return self._apply(texts, self._ask_count, sum)

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self._apply(texts, self._ask_ids, b"".join)


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str, use: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer; ``use`` keeps memos of counts and of ids apart."""
    return PieceEncoder(path)
