"""64-bit hashes of words and word shingles, alike on every worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash

T = TypeVar("T")

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


#: The memo that this Python worker holds, and whose it is.
_held: tuple[object, object] = (None, None)


def worker_memo(owner: object, make: Callable[[], T]) -> T:
    """This worker's memo, if it is the owner's; else it goes and make() gives a new one.

    Spark keeps Python workers from one task to the next, and each operator has a memo of
    its own. A worker holds only the memo of the operator that ran last, so an executor's
    memory doesn't grow with the operators that it has served."""
    global _held
    if _held[0] != owner:
        _held = (None, None)
        pa.default_memory_pool().release_unused()
        _held = (owner, make())
    return _held[1]


class WordHashes(dict):
    """Word (bytes) to its hash. Words of over `longest` bytes aren't held, and the memo starts
    anew when it holds `most`, so it takes some 30 MB at most."""

    def __init__(self, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word):
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    """This worker's memo of word hashes, which all operators over shingles share."""
    return worker_memo("words", WordHashes)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive words; one for all words of a shorter, non-empty text."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * STEP + words[i : n - k + 1 + i]
    return mixed(out)
