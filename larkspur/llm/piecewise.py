"""Encoding by cached pieces.

A tokenizer that first splits text by a pattern encodes each piece on its own, so the ids
of a piece never depend on its neighbours. ``PieceEncoder`` splits Latin-range texts with
the same pattern, lets the tokenizers library encode each piece it hasn't met, and keeps a
bounded cache in the Python worker. Other texts go to the library whole: those with characters from U+0250 on,
with characters that the tokenizer's normalisation may turn into such, and those with a special token's string.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers

LATIN_END = "ɐ"
CACHE_CHARS = 64  # longer pieces aren't kept
SPACE = r"\t-\r \x85\xa0"  # the tokenizer's spaces below U+0250; Python's \s also has U+001C to U+001F


def latin(kind: str) -> str:
    """A regular-expression class body: characters below U+0250 whose category starts with ``kind``."""
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c).startswith(kind))


def byte_level_pattern() -> re.Pattern:
    letter, number = latin("L"), latin("N")
    # words first, as most pieces are: none of the other alternatives starts as they do
    return re.compile(rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def word_end_pattern() -> re.Pattern:
    letter, number = latin("L"), latin("N")
    return re.compile(rf"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{SPACE}{letter}{number}]+")


@lru_cache(maxsize=4)
def library(model: str, plain: bool):
    """The tokenizer; with ``plain`` a special token's string in a text is ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(model))
    tokenizer.encode_special_tokens = plain
    return tokenizer


def changing(fold: Callable[[str], str]) -> str:
    """The Latin characters that ``fold`` doesn't turn into one Latin character each."""
    return "".join(c for c in map(chr, range(ord(LATIN_END))) if len(fold(c)) != 1 or fold(c) >= LATIN_END)


class PieceEncoder:
    def __init__(self, model: str, pattern: re.Pattern, kept_gap: bool, plain: bool, fold: Callable[[str], str] = lambda x: x, most: int = 250_000):
        """``fold``: the tokenizer's normalisation of Latin texts. ``plain``: special tokens' strings are ordinary text.

        ``kept_gap``: a line end between two pieces is a piece of its own, else it vanishes. ``most``: pieces kept.
        """
        self.model, self.plain, self.split, self.fold = model, plain, pattern.findall, fold
        self.special = [] if plain else [x.content for x in library(model, plain).get_added_tokens_decoder().values()]
        self.odd = changing(fold)  # none of them is in Latin-1
        self.step = 2 if kept_gap else 1
        self.most = most
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = library(self.model, self.plain).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces, many in one text: the library numbers the pieces it finds (word_ids)."""
        plain = [x for x in new if x.strip() and not x[1:].isspace() and len(x) <= CACHE_CHARS]
        found: dict[str, bytes] = {}
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            code = library(self.model, self.plain).encode("\n".join(part), add_special_tokens=False)
            ids, words = np.array(code.ids, dtype="<u4"), np.array(code.word_ids, dtype=np.int64)
            firsts = np.searchsorted(words, np.arange(0, self.step * len(part), self.step))
            ends = np.searchsorted(words, np.arange(0, self.step * len(part), self.step), side="right")
            raw = ids.tobytes()
            found |= {x: raw[4 * a : 4 * b] for x, a, b in zip(part, firsts.tolist(), ends.tolist(), strict=True)}
        rest = [x for x in new if x not in found]
        return found | dict(zip(rest, self.whole(rest), strict=True))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.is_latin(text):
            return self.whole([text])[0]
        pieces = self.split(self.fold(text))
        got = list(map(self.known.get, pieces))
        if None in got:
            missing = {x for x, y in zip(pieces, got, strict=True) if y is None}
            fresh = self.pieces(list(missing))
            got = [fresh[x] if y is None else y for x, y in zip(pieces, got, strict=True)]
            if len(self.known) + len(fresh) > self.most:
                self.known.clear()
            self.known.update((x, y) for x, y in fresh.items() if len(x) <= CACHE_CHARS)
        return b"".join(got)

    def is_latin(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if max(text) >= LATIN_END or any(c in text for c in self.odd):
                return False
        return not any(x in text for x in self.special)


@lru_cache(maxsize=1)
def byte_level(model: str = "byte_bpe_50k.json") -> PieceEncoder:
    return PieceEncoder(model, byte_level_pattern(), kept_gap=True, plain=True)


@lru_cache(maxsize=1)
def word_end(model: str = "word_bpe_49k.json") -> PieceEncoder:
    return PieceEncoder(model, word_end_pattern(), kept_gap=False, plain=False, fold=str.lower, most=1_000_000)
