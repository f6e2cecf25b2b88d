"""Minimal perfect hash of 128-bit keys, with one fingerprint and one count a key; a numpy helper used inside tasks.

Levels of bits: a key alone at its place of a level is settled there, keys that meet go
on to the next level. The index of a key is the number of bits set before its own, so n
keys have the indices 0 to n - 1. A key that was not built in gets any index or none;
the fingerprint at that index tells it apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from hrefwarden.llm.arrow_text import mixed

#: Bits of a level for each key that is still to be settled.
SPACE = 2
LEVELS = 24

_ODD = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * _ODD & 0xFFFFFFFFFFFFFFFF)
    return mixed(keys[:, 0] ^ mixed(keys[:, 1] + seed)) % np.uint64(size)


def compact(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned integers that hold them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


@dataclass
class PerfectHash:
    sizes: list[int]  # bits of each level
    bits: np.ndarray  # uint64 words of all levels, one after the other
    rest: np.ndarray  # keys no level has settled; they have the last indices
    fingerprints: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.before = np.zeros(len(self.bits) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.bits), out=self.before[1:])

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        """``keys`` are distinct rows of two uint64."""
        left, sizes, words = keys, [], []
        while len(left) and len(sizes) < levels:
            size = -(-SPACE * len(left) // 64) * 64
            places = _places(left, len(sizes), size)
            alone = np.bincount(places.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[places]]
        bits = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        made = cls(sizes, bits, left, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8))
        at = made.indices(keys)
        made.fingerprints = np.zeros(len(keys), dtype=np.uint64)
        made.fingerprints[at] = keys[:, 1]
        ordered = np.zeros(len(keys), dtype=np.uint64)
        ordered[at] = counts
        made.counts = compact(ordered)
        return made

    def indices(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some of those that were not built in."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        first = 0
        for level, size in enumerate(self.sizes):
            places = _places(keys[open_], level, size)
            at, bit = first + (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            word = self.bits[at]
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[hit]] = (self.before[at] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            first += size >> 6
        if len(self.rest):
            settled = int(self.before[-1])
            for k, key in enumerate(self.rest):
                found[open_[(keys[open_] == key).all(axis=1)]] = settled + k
        return found

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for one that was not built in."""
        at = self.indices(keys)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == keys[known, 1]
        out = np.zeros(len(keys), dtype=np.uint64)
        out[known] = self.counts[at[known]]
        return out

    def packed(self) -> dict:
        return {
            "sizes": self.sizes,
            "bits": self.bits.tobytes(),
            "rest": self.rest.tobytes(),
            "fingerprints": self.fingerprints.tobytes(),
            "counts": self.counts.tobytes(),
            "width": self.counts.dtype.itemsize,
        }

    @classmethod
    def unpacked(cls, row: dict) -> PerfectHash:
        def numbers(name):
            return np.frombuffer(row[name], dtype=np.uint64)

        counts = np.frombuffer(row["counts"], dtype=f"u{row['width']}")
        return cls(list(row["sizes"]), numbers("bits"), numbers("rest").reshape(-1, 2), numbers("fingerprints"), counts)


PACKED = "sizes array<long>, bits binary, rest binary, fingerprints binary, counts binary, width int"
