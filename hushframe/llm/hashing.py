"""Words of a text and hashes of word sequences, on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

# Words remembered by one task; what comes later is hashed anew each time.
REMEMBERED = 300_000
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, any value serves


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space (space and 0x09 to 0x0D), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, with bounded memory."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries; empty if there are fewer."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    total, done = np.zeros(n, np.uint64), 0
    part, size = h, 1  # part[i] is the polynomial over h[i : i + size]
    with np.errstate(over="ignore"):
        while True:
            power = np.uint64(pow(_MULTIPLIER, size, 1 << 64))
            if k & size:
                total = total * power + part[done : done + n]
                done += size
            if done == k:
                return _mixed(total)
            part = part[:-size] * power + part[size:]
            size *= 2


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive entries."""
    return _sliding(h, w, np.minimum)


def greatest(h: np.ndarray, w: int) -> np.ndarray:
    return _sliding(h, w, np.maximum)


def _sliding(h: np.ndarray, w: int, pick) -> np.ndarray:
    if len(h) < w:
        return h[:0]
    size = 1
    while size * 2 <= w:
        h = pick(h[:-size], h[size:])
        size *= 2
    rest = w - size
    return pick(h[: len(h) - rest], h[rest:]) if rest else h
