"""A minimal perfect hash of distinct 64-bit keys, built and asked in numpy.

Level by level, keys that are alone at their position set a bit and are done; the others go on to the next level. A key's
number is the count of bits before its own, so n keys get the numbers 0 to n - 1. A key that was never put in gets any
number or none: callers compare the stored fingerprint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.text import mix

ROOM = 2.0  # positions per key of a level
_STEP = 0xA0761D6478BD642F


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * _STEP % (1 << 64))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    sizes: np.ndarray  # positions of each level, multiples of 64
    words: np.ndarray  # the levels' bits, one after the other
    before: np.ndarray  # bits set before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = keys.view(np.uint64)
        sizes, parts = [], []
        while len(left):
            size = -(-int(ROOM * len(left)) // 64) * 64 or 64
            at = _position(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            parts.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, np.concatenate([[0], np.cumsum(counts)])[: len(words)])

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level holds one."""
        keys = keys.view(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            at = _position(keys[open_], level, int(size))
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            under = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.before[word[hit]] + np.bitwise_count(under)
            open_ = open_[~hit]
            base += int(size) // 64
        return found
