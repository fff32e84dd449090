"""Hashed word shingles of texts, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .arrow import GROUP_BYTES, groups

SIZE = 5
PRIME = 0x9E3779B97F4A7C15


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte (A-Z as a-z; 0 for white space), and which bytes are white space."""
    numbers = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
    numbers[65:91] = numbers[97:123]
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    numbers[white] = 0
    return numbers, white


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, PRIME, np.uint64)
    down = np.full(n, pow(PRIME, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets(data: memoryview, offsets: np.ndarray, size: int = SIZE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles.

    A row with fewer words than ``size`` has one shingle, all its words; a row without words has none.
    """
    numbers, white = _tables()
    for lo, hi in groups(offsets):
        block = np.frombuffer(data[offsets[lo]:offsets[hi]], np.uint8)
        edges = offsets[lo:hi + 1] - offsets[lo]
        n = len(block)
        ink = ~white[block]
        opens = ink.copy()
        opens[1:] &= ~ink[:-1]
        first = edges[:-1][edges[:-1] < edges[1:]]
        opens[first] = ink[first]
        begin = np.flatnonzero(opens)
        words = np.searchsorted(begin, edges)
        counts = np.diff(words)
        if not len(begin):
            yield from (np.zeros(0, np.uint64) for _ in range(lo, hi))
            continue
        room = max(n, GROUP_BYTES)
        up, down = _powers(1 << (room - 1).bit_length())
        # a word's hash: its stretch of the running polynomial, moved back to power 0; white space adds nothing
        value = np.add.reduceat(numbers[block] * up[:n], begin) * down[begin]
        value = mix(value)
        shingle = value.copy()
        left = np.repeat(words[1:], counts) - np.arange(len(begin))  # words from here to the end of the row
        factor = PRIME
        for j in range(1, size):
            more = np.zeros(len(value), np.uint64)
            more[:-j] = value[j:] if j < len(value) else 0
            more[left <= j] = 0
            shingle += more * np.uint64(factor)
            factor = factor * PRIME % (1 << 64)
        shingle = mix(shingle)
        for a, c in zip(words.tolist(), counts.tolist()):
            yield np.unique(shingle[a:a + (c - size + 1 if c >= size else min(c, 1))])
