"""A hash table in numpy arrays, with open addressing and vectorised look-ups."""

from __future__ import annotations

import numpy as np


class Table:
    """Maps non-negative int64 keys to int64 values; ``none`` for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int = -1):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        size = 1 << (len(keys) * 4 + 4).bit_length()
        self.none, self.mask, self.keys, self.values = none, np.uint64(size - 1), np.full(size, -1, np.int64), np.full(size, none, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # all that found their slot taken try the next
            at = slot[left]
            _, first = np.unique(at, return_index=True)
            free = first[self.keys[at[first]] == -1]
            won = left[free]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.delete(left, free)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & self.mask).astype(np.int64)

    def get(self, want: np.ndarray) -> np.ndarray:
        shape, want = want.shape, want.ravel()
        slot, out, left = self._slot(want), np.full(len(want), self.none, np.int64), np.flatnonzero(want >= 0)
        while len(left):
            there = self.keys[slot[left]]
            hit = there == want[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != -1)]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return out.reshape(shape)
