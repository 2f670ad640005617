"""A minimal perfect hash of distinct integers: each key gets a number of its own from 0 to n - 1.

Level by level, the keys that are alone in their cell of a bit table get a bit there; the others go on to the next,
smaller table. A key's number is the rank of its bit. About three bits a key; all steps work on whole arrays.
"""

from __future__ import annotations

import numpy as np

ROOM = 2
LEAST_BITS = 64
STEP = 0x9E3779B97F4A7C15
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
HALF, SIX, ONE, LOW = np.uint64(32), np.uint64(6), np.uint64(1), np.uint64(63)


def scattered(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of each key, others on each level."""
    values = keys.astype(np.uint64) + np.uint64((level + 1) * STEP & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        values = (values ^ (values >> HALF)) * MULTIPLIER
    return values ^ (values >> HALF)


def _cells(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return scattered(keys, level) % np.uint64(bits)


class PerfectHash:
    """`sizes` has the bits of each level, `words` all levels' bits one after the other, 64 to a word."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum([size // 64 for size in sizes]))).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def __len__(self) -> int:
        return int(self.ranks[-1])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; what a key outside the set gets is of no meaning, -1 or another's number."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            cell = _cells(keys[left], level, size)
            word = self.starts[level] + (cell >> SIX).astype(np.int64)
            bit = cell & LOW
            hit = (self.words[word] >> bit) & ONE == ONE
            below = self.words[word] & ((ONE << bit) - ONE)
            found[left[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return found


def build(keys: np.ndarray) -> PerfectHash:
    """`keys` must be distinct."""
    sizes, tables, level = [], [], 0
    while len(keys):
        size = max(LEAST_BITS, -(-ROOM * len(keys) // 64) * 64)
        cell = _cells(keys, level, size).astype(np.int64)
        alone = np.bincount(cell, minlength=size)[cell] == 1
        bits = np.zeros(size, np.uint8)
        bits[cell[alone]] = 1
        sizes.append(size)
        tables.append(np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64))
        keys, level = keys[~alone], level + 1
    return PerfectHash(sizes, np.concatenate(tables) if tables else np.zeros(0, np.uint64))
