"""Word hashes and word shingles as numpy arrays. Words are runs of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

from genomill.llm._common import held

CACHE_WORDS = 300_000
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
A, B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of a word; the words seen are kept, and forgotten all at once when they are many."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(text: bytes) -> np.ndarray:
    """Of a text's words, from the one cache for all tasks of a worker process."""
    return held(("words",), WordHashes).of(text)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * A
    x = (x ^ (x >> U(27))) * B
    return x ^ (x >> U(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive words; of all words where there are fewer; nothing for none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out *= STEP
        out += words[i : n - k + 1 + i]
    return mixed(out)
