"""Exact ids of the public word-level BPE, one cached word at a time.

The tokenizer's normaliser and pre-tokenizer never look across white space, so a text's ids are the
concatenated ids of its white-space separated words.  Words are kept with their ids; a new word is
split by the tokenizer's own pattern and merged by the tokenizer's own model.  Texts for which that
would not hold (special-token strings, separators that the two sides see differently) go to the
tokenizer whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex

#: Words remembered by one Python worker; the memory starts anew beyond it.
CACHE_WORDS = 150_000
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = regex.compile(r"<\||[\x1c-\x1f]")
_PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]*")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        bytes_in_order = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in bytes_in_order}
        for k, b in enumerate(x for x in range(256) if x not in self.letters):
            self.letters[b] = chr(256 + k)

    @staticmethod
    @lru_cache(maxsize=4)
    def cached(path: str) -> WordTokenizer:
        return WordTokenizer(path)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            mapped = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        # Printable ASCII and composed Latin letters are as the normaliser leaves them, but for case.
        if not (word.isprintable() if word.isascii() else _PLAIN.fullmatch(word)):
            return self._whole(word)
        word = word.lower()
        if word.isalpha():
            return self._part(word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join([self._part(p) for p in _PATTERN.findall(word)])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if _ODD.search(text):
                out.append(self._whole(text))
                continue
            words = text.split()
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = self._word(w)
                out.append(b"".join([known[w] for w in words]))
        return out
