"""A minimal perfect hash over 64-bit keys: levels of bit arrays in which a key takes the first level where no other
key shares its bit, then its rank among all set bits (Limasset et al., 2017)."""

import numpy as np

from paperloom.llm.words import U, mix

GAMMA = 2.0


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + U(level * 0xD6E8FEB86659FD93 % 2**64)) % U(size)).astype(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U(0xA0761D6478BD642F)) >> U(32)).astype(np.uint32)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each level, all levels' bits) for distinct 64-bit keys."""
    left, sizes, bits = mix(keys.astype(np.int64).view(U)), [], []
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _place(left, len(sizes), size)
        count = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(count == 1)
        left = left[count[at] != 1]
    return np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, bool)])


class PerfectHash:
    """Slots 0 to n - 1 for the keys it was built on; any slot or -1 for other keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.astype(np.int64).view(U))
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            at = self.base[level] + _place(h[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out
