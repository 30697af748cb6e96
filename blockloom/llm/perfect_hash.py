"""A minimal perfect hash over 64-bit keys, built and asked in numpy.

Level by level, keys hash into a bit array twice their number; a key alone on its bit
keeps it, the others go to the next level. A key's slot is the rank of its bit over all
levels, so n keys fill 0..n-1. Keys left after LEVELS (equal or unlucky) are listed.
"""

from __future__ import annotations

import numpy as np

from .textgrid import mix

LEVELS = 32
_STEP = 0xD1B54A32D192ED03


def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = mix(keys ^ np.uint64((_STEP * (level + 1)) & (2**64 - 1)))
    return ((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(np.packbits(bits, bitorder="little")), dtype=np.int64)])
        self.packed = np.packbits(bits, bitorder="little")

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.asarray(keys, np.uint64)
        sizes, parts = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(8, 2 * len(keys))
            at = _at(keys, level, size).astype(np.int64)
            count = np.bincount(at, minlength=size)
            parts.append(count == 1)
            sizes.append(size)
            keys = keys[count[at] != 1]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, any slot or -1."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _at(keys[open_], level, size).astype(np.int64) + self.base[level]
            hit = self.bits[at]
            found = at[hit]
            below = np.bitwise_count(self.packed[found >> 3] & ((1 << (found & 7)) - 1).astype(np.uint8))
            out[open_[hit]] = self.rank[found >> 3] + below
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.rank[-1] + at[same]
        return out

    def dump(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array(self.sizes, np.int64), "bits": self.packed, "n_bits": np.array([len(self.bits)], np.int64), "rest": self.rest}

    @classmethod
    def load(cls, parts: dict[str, np.ndarray]) -> PerfectHash:
        bits = np.unpackbits(parts["bits"], bitorder="little")[: int(parts["n_bits"][0])].astype(bool)
        return cls(parts["sizes"].tolist(), bits, parts["rest"])
