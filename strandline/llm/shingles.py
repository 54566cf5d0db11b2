"""Word shingles of many texts at once, as 64-bit hashes, with NumPy."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a multiplier modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.all = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.all) < n:
            x = np.full(max(n, 1 << 16), self.base & (2**64 - 1), np.uint64)
            x[0] = 1
            self.all = np.cumprod(x, dtype=np.uint64)
        return self.all[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def shingles(texts: list[bytes], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every shingle occurrence. A text of fewer words is one shingle."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = turns[0::2], turns[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _UP.upto(len(data)), dtype=np.uint64)])
    words = mix((total[stops] - total[starts]) * _DOWN.upto(len(data))[starts] + (stops - starts).astype(np.uint64))
    doc = np.searchsorted(ends, starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(doc)) - first[doc]
    left = n[doc] - place  # words from here to the end of the text
    begin = np.flatnonzero((left >= size) | ((place == 0) & (left < size)))
    h = np.zeros(len(begin), np.uint64)
    have = left[begin]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        h = h * np.uint64(_BASE) + np.where(have > k, padded[begin + k] + np.uint64(k + 1), np.uint64(0))
    return doc[begin], mix(h + np.uint64(_GOLDEN))
