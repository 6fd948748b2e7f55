"""The common notion of a word: after lower-casing, a run of a-z and digits, or one character U+4E00..U+9FFF."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

_words = re.compile("[a-z0-9]+|[一-鿿]").findall

#: Distinct words whose hashes a Python worker keeps; the memory's bound, results don't depend on it.
KEPT_WORDS = 500_000


def words(text: str) -> list[str]:
    return _words(text.lower())


def word_hash(word: str) -> int:
    """64 bits, never 0."""
    return xxhash.xxh64_intdigest(word) or 1


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = word_hash(word)
        return value


_known = _Hashes()


def hashes(tokens: Iterable[str], count: int) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, tokens), dtype=np.uint64, count=count)
