"""A minimal perfect hash of 64-bit keys with fingerprints.

Levels of bit arrays: at each level a remaining key takes the slot its hash names if no other does;
the rest go on to the next level. A key's index is the number of set bits before its slot, so n
keys get the indexes 0 to n - 1 with about 3 to 4 bits each. Everything is vectorised.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64
MAGIC = b"MPH1"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of keys for a seed (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.sizes = [len(x) * 8 for x in levels]
        self.bits = [np.unpackbits(x, bitorder="little") for x in levels]
        ones = [int(x.sum()) for x in self.bits]
        starts = np.concatenate(([0], np.cumsum(ones)))[: len(ones)]
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 + s for b, s in zip(self.bits, starts)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct int64 values."""
        rest, levels = np.ascontiguousarray(keys, np.int64), []
        while len(rest):
            if len(levels) >= MAX_LEVELS:
                raise ValueError("keys must be distinct")
            size = max(8, -(-int(GAMMA * len(rest)) // 8) * 8)
            slot = (mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[slot]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys outside the set, any index for others."""
        keys = np.ascontiguousarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            if not len(left):
                break
            slot = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = bits[slot] == 1
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mixed(np.ascontiguousarray(keys, np.int64), 1 << 20) >> np.uint64(32)).astype("<u4")

    def dump(self) -> bytes:
        head = MAGIC + struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) for x in self.levels)
        return head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and the number of bytes it took."""
        if data[:4] != MAGIC:
            raise ValueError("not a perfect hash")
        (n,) = struct.unpack_from("<I", data, 4)
        sizes = struct.unpack_from(f"<{n}Q", data, 8)
        at, levels = 8 + 8 * n, []
        for s in sizes:
            levels.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        return cls(levels), at
