"""Minimal perfect hashes of sets of byte strings, by levels of bit arrays.

Level by level, every key not placed yet points at a bit; bits met by one key only are set and
those keys are placed, the others go on to the next level. A key's slot is the number of set
bits before its own, so n keys get the slots 0 .. n-1. A key outside the set may be given some
slot too: users compare the key stored for the slot.

Keys are dealt over shards, so that each shard is built by one task; ``Lookup`` reads many
shards as one array.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .hashing import mix

BITS_PER_KEY = 1.5
STEP = np.uint64(0x9E3779B97F4A7C15)


def digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each key's hash: one deals keys over shards, both place them."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    both = np.frombuffer(raw, "<u8").reshape(len(keys), 2)
    return both[:, 0], both[:, 1]


def shard_of(low: np.ndarray, n_shards) -> np.ndarray:
    return (mix(low) % np.asarray(n_shards, np.uint64)).astype(np.int64)


def _placed(low: np.ndarray, high: np.ndarray, seed) -> np.ndarray:
    """The 64 bits that place a key; another seed tells apart keys that share them."""
    return mix(high + mix(low * (np.asarray(seed, np.uint64) * np.uint64(2) + np.uint64(1))))


def _bit(placed: np.ndarray, level: int, sizes) -> np.ndarray:
    step = np.uint64(((level + 1) * int(STEP)) & (2 ** 64 - 1))
    return (mix(placed + step) % np.asarray(sizes, np.uint64)).astype(np.int64)


def build(keys: list[bytes]) -> dict:
    """The perfect hash of distinct ``keys``: seed, level sizes, packed bits, keys by slot."""
    low, high = digests(keys)
    seed = 0
    placed = _placed(low, high, seed)
    while len(np.unique(placed)) < len(keys):
        seed += 1
        placed = _placed(low, high, seed)
    sizes, bits, rest = [], [], np.arange(len(keys))
    order = []
    while len(rest):
        size = max(8, int(BITS_PER_KEY * len(rest)))
        at = _bit(placed[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        order.append(rest[fits][np.argsort(at[fits])])
        sizes.append(size)
        bits.append(alone)
        rest = rest[~fits]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return {"seed": seed, "sizes": sizes, "bits": np.packbits(flat).tobytes(), "keys": [keys[i] for i in order.tolist()]}


class Lookup:
    """Slots of keys in a list of built shards (``build``), numbered through all shards."""

    def __init__(self, shards: list[dict]):
        levels = max((len(s["sizes"]) for s in shards), default=0)
        self.sizes = np.ones((len(shards), levels), np.int64)
        self.starts = np.zeros((len(shards), levels), np.int64)
        self.levels = np.array([len(s["sizes"]) for s in shards], np.int64)
        self.seeds = np.array([s["seed"] for s in shards], np.uint64)
        bits, keys, first, at = [], [], [], 0
        for i, s in enumerate(shards):
            n = sum(s["sizes"])
            self.sizes[i, :len(s["sizes"])] = s["sizes"]
            self.starts[i, :len(s["sizes"])] = at + np.cumsum(s["sizes"]) - s["sizes"]
            bits.append(np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=n).astype(bool))
            first.append(len(keys))
            keys += s["keys"]
            at += n
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = (np.cumsum(self.bits) - self.bits).astype(np.int32)
        self.keys, self.first = keys, np.array(first, np.int64)

    def slots(self, keys: list[bytes], shard: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key (-1: not in the set), its stored key compared in full."""
        slot = np.full(len(keys), -1, np.int64)
        placed = _placed(low, high, self.seeds[shard])
        rest = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            rest = rest[self.levels[shard[rest]] > level]
            if not len(rest):
                break
            at = self.starts[shard[rest], level] + _bit(placed[rest], level, self.sizes[shard[rest], level])
            hit = self.bits[at]
            slot[rest[hit]] = self.rank[at[hit]]
            rest = rest[~hit]
        stored = self.keys
        same = [s >= 0 and stored[s] == k for s, k in zip(slot.tolist(), keys)]
        slot[~np.array(same, bool)] = -1
        return slot
