"""Minimal perfect hashing of 64 bit keys in numpy: levels of bit arrays, of which each holds the keys that no other
key collides with, and ranks within them. Lookups cost a few probes whatever the number of keys."""

from __future__ import annotations

import struct

import numpy as np

LOAD, LEVELS = 2.0, 40
_FIXED = struct.Struct("<III")


def mixed(x: np.ndarray, level: int) -> np.ndarray:
    """A 64 bit finaliser (shift, multiply, twice) over keys, different for each level."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """16 bits of a key, stored to tell keys of the index from others."""
    return (mixed(keys, LEVELS + 1) >> np.uint64(48)).astype(np.uint16)


class MinimalPerfectHash:
    """Maps n distinct keys onto 0..n-1. Any other key maps to -1 or to some slot; fingerprints tell it apart."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.ranks = [np.cumsum(bits, dtype=np.int64) - bits for bits in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, levels = np.unique(keys.astype(np.uint64)), []
        if len(left) != len(keys):
            raise ValueError("keys must be distinct")
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(len(left) * LOAD))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for k, bits in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                return out
            at = (mixed(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
        if len(self.rest):
            open_ = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = _FIXED.pack(len(self.levels), len(self.rest), 0) + np.array([len(b) for b in self.levels], "<u4").tobytes()
        return head + self.rest.astype("<u8").tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalPerfectHash:
        n, rest, _ = _FIXED.unpack_from(raw)
        at = _FIXED.size + 4 * n
        sizes = np.frombuffer(raw, "<u4", n, _FIXED.size)
        left = np.frombuffer(raw, "<u8", rest, at)
        at, levels = at + 8 * rest, []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels, left)
