"""64-bit hashes of words and of runs of words, for numpy code inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
OTHER = 0xD1B54A32D192ED03 | 1
CACHE_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def hash_words(words: list[bytes], cache: dict | None = None) -> np.ndarray:
    cache = _Hashes() if cache is None else cache
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def new_cache() -> dict:
    return _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every n values in a row (mod 2**64), by doubling; shorter input gives none."""
    if len(h) < n:
        return h[:0]
    if n == 1:
        return h
    half = n // 2
    r = rolling(h, half, base)
    r = r[: len(r) - half] * np.uint64(pow(base, half, 1 << 64)) + r[half:]
    return r[:-1] * np.uint64(base) + h[n - 1 :] if n % 2 else r


def windows(h: np.ndarray, lengths: np.ndarray, n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words within texts laid end to end, and where they start."""
    r = mixed(rolling(h, n, base))
    ok = np.ones(len(r), dtype=bool)
    ends = np.cumsum(lengths)
    for back in range(1, n):  # a start in the last n - 1 words of a text has no window
        at = (ends - back)[lengths >= back]
        ok[at[at < len(r)]] = False
    at = np.flatnonzero(ok)
    return r[at], at
