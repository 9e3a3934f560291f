"""A minimal perfect hash over 64-bit key hashes, with stored fingerprints.

Keys are placed level by level: a key that falls on a bit of its own stays there, keys that collide
go on to the next level. A key's slot is the rank of its bit over all levels, so slots are 0 to n - 1
without gaps. A lookup tries a bit a level, fewer than two on average whatever n, and a 32-bit
fingerprint in the slot tells keys apart that were never stored (but for one in 2**32).
"""

from __future__ import annotations

import numpy as np

_NONE = np.int64(-1)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit values, another one for each salt."""
    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1B873593CC9E2D51) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def key_hashes(keys: np.ndarray, is_null: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Hashes of (key, turn), the turn counting equal keys; distinct for distinct keys at turn 0."""
    h = mixed(keys.astype(np.int64).view(np.uint64), 1)
    h = np.where(is_null, mixed(np.zeros(len(keys), np.uint64), 2), h)
    return np.where(turn > 0, mixed(h + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 3), h)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mixed(h, 4) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """`levels` are bitmaps as 64-bit words."""
        self.levels = levels
        self.ranks, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.n = total

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        if len(np.unique(h)) < len(h):
            raise ValueError("key hashes must be distinct")
        levels, left = [], h
        while len(left):
            n_words = max(1, -(-2 * len(left) // 64))
            at = mixed(left, 16 + len(levels)) % np.uint64(64 * n_words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * n_words)[at.astype(np.int64)] == 1
            bits = np.zeros(64 * n_words, np.uint8)
            bits[at[alone].astype(np.int64)] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of every stored key; some slot or -1 for others."""
        out = np.full(len(h), _NONE)
        open_ = np.arange(len(h))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = mixed(h[open_], 16 + level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = ranks[word[here]] + below[here]
            open_ = open_[~here]
        return out
