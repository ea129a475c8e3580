"""Minimal perfect hashing of one shard of keys, by levels of bit maps.

On each level the open keys are hashed to a bit map; a key that is alone at its bit is
placed, the others go on to the next level. The number of a key is the rank of its bit
over all levels. Keys that are still open after ``LEVELS`` (equal 64-bit hashes) get the
last numbers and are found by themselves. A number is only a guess for a word that is not
a key, so the keys are stored in the order of their numbers and compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

LEVELS = 32
SPARE = 2  # bits a key on a level
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, any value serves


def hashes(keys: Sequence[bytes]) -> np.ndarray:
    """64-bit hashes, equal to Spark's ``xxhash64`` of the same strings."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """As ``shiftrightunsigned(xxhash64(key), 1) % shards`` in Spark."""
    return (h >> np.uint64(1)) % np.uint64(shards)


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + _STEP * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(keys: Sequence[bytes]) -> tuple[bytes, list[int], list[int]]:
    """The bit maps, the size of each level in bits, and the keys' places in number order."""
    h = hashes(keys)
    left = np.arange(len(h))
    maps, sizes, order = [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-len(left) * SPARE // 64) * 64
        at = _places(h[left], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        maps.append(np.packbits(bits, bitorder="little").tobytes())
        sizes.append(size)
        order += left[alone][np.argsort(at[alone])].tolist()
        left = left[~alone]
    return b"".join(maps), sizes, order + left.tolist()


class PerfectHash:
    """Numbers of the keys that ``build`` has placed; ``keys`` are in number order."""

    def __init__(self, bits: bytes, sizes: Sequence[int], keys: Sequence[bytes]):
        self.sizes, self.keys = list(sizes), keys
        self.words = np.frombuffer(bits, "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        placed = int(ones.sum())
        self.open = {k: placed + i for i, k in enumerate(keys[placed:])}

    def numbers(self, found: Sequence[bytes], h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that are no key."""
        out = np.full(len(found), -1, np.int64)
        left, base = np.arange(len(found)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _places(h[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[at >> 6] + np.bitwise_count(below))[here]
            left, base = left[~here], base + size
        for i in left.tolist():
            out[i] = self.open.get(found[i], -1)
        keys = self.keys
        wrong = [i for i, n in enumerate(out.tolist()) if n >= 0 and keys[n] != found[i]]
        out[wrong] = [self.open.get(found[i], -1) for i in wrong]
        return out
