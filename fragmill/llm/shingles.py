"""Word-shingle sets as sorted arrays of 64-bit hashes, for the operators on n-gram overlap."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a worker remembers; the table is emptied when it is full.
REMEMBERED = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles.

    A-Z is lower-cased; words are maximal runs of other than space and U+0009 to U+000D. Fewer words than ``size``
    give one hash of the whole sequence; no words or null give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    get = _words
    hashes = np.array([get[w] for w in words], np.uint64)
    span = min(size, len(hashes))
    with np.errstate(over="ignore"):
        total = np.full(len(hashes) - span + 1, np.uint64(span))
        for k in range(span):
            total = total * _STEP + hashes[k : len(hashes) - span + 1 + k]
    return np.unique(mix(total))


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit number that equal sets share."""
    with np.errstate(over="ignore"):
        both = np.array([hashes.sum(dtype=np.uint64) + np.uint64(len(hashes)), np.bitwise_xor.reduce(hashes)], np.uint64)
        return int((mix(mix(both[:1]) ^ both[1:])).view(np.int64)[0])
