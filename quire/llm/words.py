"""Hashes of words and of word windows, vectorised over a text.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split`` cuts exactly there.
"""

from __future__ import annotations

import numpy as np
import xxhash

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.made = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.made) < n:
            size = 1 << (n - 1).bit_length()
            self.made = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base, np.uint64)]), dtype=np.uint64)
        return self.made[:n]


_UP, _DOWN = _Powers(_B), _Powers(_INV)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``size`` word hashes from each start (every start by default)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _UP.upto(len(h)), dtype=np.uint64)])
    if starts is None:
        return mix((total[size:] - total[:n]) * _DOWN.upto(n))
    return mix((total[starts + size] - total[starts]) * _DOWN.upto(n)[starts])
