"""A minimal perfect hash over 64-bit keys, vectorised: levels of bit arrays, a key sits at its first level without a clash."""

from __future__ import annotations

import numpy as np

GAMMA = 2
MAX_LEVELS = 40


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct keys 0 to n - 1 in about 3 bits a key.  Unknown keys get some number or -1: compare fingerprints."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.unpackbits(bits)[: int(self.first[-1])], dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, found = keys.astype(np.uint64), [], []
        for level in range(MAX_LEVELS):
            if not len(keys):
                break
            m = max(64, GAMMA * len(keys))
            at = (mix(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            found.append(alone)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys repeat")
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(found)) if found else np.zeros(0, np.uint8))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = (mix(keys[left], level) % np.uint64(m)).astype(np.int64) + self.first[level]
            hit = ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out
