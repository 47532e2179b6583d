"""Token ids of whole texts with a public vocabulary file, by a bounded cache of chunks.

For a vocabulary whose pre-tokenizer drops white space, no token crosses a blank
or a line feed, so a text's ids are the ids of its chunks one after another.
Chunks of ASCII and Latin letters go through a byte-pair coder over the same
ranks (end of word as a byte UTF-8 never has); all others, and vocabularies of
another kind, through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

#: Fixed values of vocabularies with word ends: normaliser steps, pre-tokenizer pattern and word-end suffix.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Chunks of a generation, of which two are kept, and characters of the longest chunk kept: bounds a worker's cache.
CACHE_CHUNKS = 250_000
CACHE_CHARS = 48
#: Chunks that the coder takes: nothing that normalisation would change but the case, and no special token's mark.
_PLAIN = re.compile(r"(?:(?!<\|)[\x21-\x7eÀ-ÖØ-öø-ÿ])*\Z")
_WORD = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]*)([.,;:!?%$#&*]*)\Z")
#: The pre-tokenizer's pattern over the characters of plain chunks in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit. Two generations: what is asked for again moves to the new one."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids

    def bound(self) -> None:
        if len(self) > CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()


class TextTokenizer:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_chunk = steps == WORD_NORMALIZERS and splits[:1] == [WORD_PATTERN] and spec["model"].get("end_of_word_suffix") == WORD_END
        if self.by_chunk:
            import tiktoken

            special = {x["id"] for x in spec["added_tokens"]}
            byte = _byte_of_char()
            ranks = {}
            for token, i in spec["model"]["vocab"].items():
                if i not in special:
                    ends = token.endswith(WORD_END)
                    ranks[bytes(byte[c] for c in token.removesuffix(WORD_END)) + b"\xff" * ends] = i
            words = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            # not part of the public interface; where another version lacks it, all goes to the library
            self.coder = getattr(getattr(words, "_core_bpe", None), "encode_single_piece", None)
            self.chunks = _Chunks(self._chunk)
            self.marks: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The library's tokenizer; it is large, so it is there once a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _coded(self, piece: str) -> bytes:
        return array("I", self.coder(piece.encode() + b"\xff")).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        word = _WORD.match(chunk) if self.coder else None
        if word:  # letters and the marks after them are pieces of their own
            letters, marks = word.groups()
            if not marks:
                return self._coded(letters.lower()) if letters else b""
            if marks not in self.marks and len(self.marks) < CACHE_CHUNKS:
                self.marks[marks] = self._coded(marks)
            end = self.marks.get(marks) or self._coded(marks)
            return (self.chunks.get(low := letters.lower()) or self.chunks.old.get(low) or self._coded(low)) + end if letters else end
        if self.coder and _PLAIN.match(chunk):
            return b"".join(map(self._coded, _PIECES.findall(chunk.lower())))
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def bound(self) -> None:
        self.chunks.bound()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit, without special tokens."""
        if not self.by_chunk:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.bound()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TextTokenizer:
    """One per Python worker and vocabulary."""
    return TextTokenizer(path)
