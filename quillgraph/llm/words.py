"""Words of a text and their hashes, shared by the text operators.

Words are maximal runs of letters and digits (Unicode L and N) of the NFKC-normalised, lower-cased
text. ``Hasher`` maps words to 64-bit hashes with a bounded per-task cache, so each distinct word
is hashed once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
#: Entries of a word cache after which it starts afresh.
CACHE_WORDS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class Hasher(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def ids(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in words(text)], dtype=np.uint64)


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = ids[: len(ids) - n + 1].copy()
    for i in range(1, n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += ids[i : len(ids) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out
