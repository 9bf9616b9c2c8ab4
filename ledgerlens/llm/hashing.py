"""Vectorised hashes of words, and Rabin-Karp hashes of word windows, in a batch of texts.

A word's hash mixes its bytes in blocks of eight, all words of a batch at once; two seeds give
two independent hashes. A polynomial hash of any stretch of words is the difference of two
prefix sums times a power, so all windows of a batch cost a few array passes; it is taken modulo
2 ** 64 with odd bases, over mixed word hashes, and mixed again.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LONG_WORD = 256
WINDOW_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse, for i below ``n`` at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        def table(b):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)
        _POWERS[base] = have = table(base), table(pow(base, -1, 1 << 64))
    return have


class Prefix:
    """Prefix sums from which the hash of any stretch of ``values`` follows."""

    def __init__(self, values: np.ndarray, base: int):
        self.power, inverse = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * inverse[:len(values)], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of every stretch of bytes ``start`` to ``end``."""
    length, seed = end - start, np.uint64(seed)
    out = mix(length.astype(np.uint64) + seed)
    # eight bytes from any place on
    block = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    rest, at = np.flatnonzero(length <= LONG_WORD), 0
    while len(rest):
        left = np.minimum(length[rest] - at, 8).astype(np.uint64)
        value = block[start[rest] + at] & (np.uint64(2 ** 64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        out[rest] = mix((out[rest] ^ mix(value + seed)) * np.uint64(0xD6E8FEB86659FD93))
        at += 8
        rest = rest[length[rest] > at]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i]:end[i]], int(seed))
    return out


class Words:
    """Words of a batch of texts (bytes): two hashes of each, its text and its place."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        text_start = np.cumsum(sizes) - sizes
        self.raw = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.raw, np.uint8)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(text_start, self.start, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts  # first word of each text

    @cached_property
    def hash(self) -> np.ndarray:
        return word_hashes(self.raw, self.start, self.end, WORD_SEEDS[0])

    @cached_property
    def second(self) -> np.ndarray:
        """A hash independent of the first."""
        return word_hashes(self.raw, self.start, self.end, WORD_SEEDS[1])

    def __len__(self) -> int:
        return len(self.start)

    def window_starts(self, size: int) -> np.ndarray:
        """Words at which a window of ``size`` words of one text starts."""
        at = np.arange(len(self))
        return at[at + size <= (self.first + self.counts)[self.text]]


def text_batches(column: pa.Array, limit: int):
    """(first row, past the last, texts as bytes) in stretches of at most ``limit`` bytes (or one
    row): only a stretch at a time is held as Python objects. Null counts as empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in text_slices(sizes, limit):
        yield a, b, [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]


def text_slices(sizes: np.ndarray, limit: int):
    """Row ranges whose sizes add up to ``limit`` at most (or one row)."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)
