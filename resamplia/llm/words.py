"""Words of UTF-8 texts and their hashes, computed for a whole batch of texts at once.

A word is a run of bytes of one class; every class used here contains either all bytes of a
non-ASCII character or none, so words of bytes are words of characters. A to Z count as a to z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed random unsigned 64-bit numbers."""
    start = np.uint64((seed * _STEP) & _MASK)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_VALUE = numbers(1, 256)[LOWER]
_BASE = int(numbers(2, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


@dataclass
class Words:
    hash: np.ndarray  # of each word, case folded
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each text, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashes: bool = True) -> Words:
    """Words of the class `kind` in the texts data[offsets[i]:offsets[i+1]]."""
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not hashes:
        return Words(np.empty(0, np.uint64), start, end, first)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    return Words(mix((sums[end] - sums[start]) * down[start]), start, end, first)


def shingles(hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within a text, and the first shingle of each text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(numbers(3, n) | np.uint64(1)):
        out += hash[at + k] * factor
    return mix(out), begin


def shingle_sets(hash: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a shorter text is one shingle, one without words
    has none."""
    runs, begin = shingles(hash, first, n)
    out = []
    for i in range(len(first) - 1):
        a, b = begin[i], begin[i + 1]
        if b > a:
            out.append(np.unique(runs[a:b]))
        elif first[i + 1] > first[i]:
            own = hash[first[i] : first[i + 1]]
            out.append(mix((own * (numbers(4, len(own)) | np.uint64(1))).sum(keepdims=True) + np.uint64(len(own))))
        else:
            out.append(np.empty(0, np.uint64))
    return out
