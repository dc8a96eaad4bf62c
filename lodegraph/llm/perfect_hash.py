"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Each level hashes the keys left over into GAMMA slots a key; a slot taken by one key alone keeps it, the others go on.
The rank of a key's slot among all taken slots is its index, so n keys get the indexes 0 to n-1; counts before blocks of
bits make a rank a matter of one block. The index alone cannot
tell a strange key; callers store a fingerprint of each key beside it.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS, BLOCK, SLICE = 2, 64, 512, 1 << 14


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """One packed bit array a level; keys must be distinct."""
    left, levels = keys.astype(np.uint64), []
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-GAMMA * len(left) // 8) * 8
        slot = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        levels.append(np.packbits(alone))
        left = left[~alone[slot]]
    return levels


class Ranked:
    """Levels with samples, so that an index takes the same few bytes whatever the number of keys: bits of all levels, each
    filled up to whole blocks of BLOCK; before each block, how many bits are set ahead of it; and of each level, where its
    bits begin and how many slots it has."""

    def __init__(self, directory: np.ndarray, samples: np.ndarray, bits: np.ndarray) -> None:
        self.directory, self.samples, self.bits = directory, samples, bits

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> Ranked:
        sizes = np.array([len(x) for x in levels], np.int64)
        whole = -(-sizes // (BLOCK // 8)) * (BLOCK // 8)
        begins = np.cumsum(whole) - whole
        bits = np.zeros(int(whole.sum()), np.uint8)
        for x, at in zip(levels, begins.tolist(), strict=True):
            bits[at : at + len(x)] = x
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        return cls(np.stack([begins * 8, sizes * 8], axis=1).astype("<u8"), (np.cumsum(ones) - ones).astype("<u4"), bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 if no level has its slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (begin, size) in enumerate(self.directory.tolist()):
            at = begin + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            for i in range(0, int(here.sum()), SLICE):
                some = at[here][i : i + SLICE]
                blocks = self.bits.reshape(-1, BLOCK // 8)[some // BLOCK]
                out[left[here][i : i + SLICE]] = self.samples[some // BLOCK] + _ahead(blocks, some % BLOCK)
            left = left[~here]
        return out


def _ahead(blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set in each block ahead of a place in it."""
    byte = at >> 3
    whole = np.where(np.arange(blocks.shape[1]) < byte[:, None], np.bitwise_count(blocks), 0).sum(axis=1, dtype=np.int64)
    part = blocks[np.arange(len(at)), byte] >> (8 - (at & 7)).astype(np.uint8) * ((at & 7) > 0)
    return whole + np.where((at & 7) > 0, np.bitwise_count(part), 0)


def lookup(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    return Ranked.of(levels).find(keys)
