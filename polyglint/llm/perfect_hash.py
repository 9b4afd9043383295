"""A minimal perfect hash of 64-bit keys: levels of bit arrays, each of which places the keys that hash alone."""

from __future__ import annotations

import numpy as np

_WORD = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit keys, different for each seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct keys to 0..n-1 with about three bits a key; other keys get any slot or -1.

    sizes: bits of each level (multiples of 64). bits: all levels, one after the other, as unsigned 64-bit words.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.offsets = np.cumsum(sizes) - sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0, levels: int = 200) -> PerfectHash:
        """keys: distinct, unsigned 64-bit."""
        sizes, bits, left = [], [], keys
        while len(left):
            if len(sizes) == levels:
                raise ValueError("the keys are not distinct")
            size = -(-max(int(spread * len(left)), 1) // _WORD) * _WORD
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.empty(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if no level has placed it."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, offset) in enumerate(zip(self.sizes.tolist(), self.offsets.tolist(), strict=True)):
            if not len(open_):
                break
            bit = offset + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, shift = self.bits[bit // _WORD], (bit % _WORD).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[bit[hit] // _WORD] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out
