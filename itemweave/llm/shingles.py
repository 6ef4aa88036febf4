"""Hashes of words and word shingles, computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multiplier of the rolling combination; words are hashed to 64 random-looking bits first.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 250_000

_cache: dict[bytes, bytes] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word. The cache lives as long as the worker and is emptied at CACHED_WORDS."""
    if len(_cache) > CACHED_WORDS:
        _cache.clear()
    get, out = _cache.get, []
    digest = xxhash.xxh3_64_digest
    for w in found:
        h = get(w)
        if h is None:
            h = _cache[w] = digest(w)
        out.append(h)
    return np.frombuffer(b"".join(out), dtype="<u8")


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k consecutive words; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, k):
        out = out * MULTIPLIER + h[j:n + j]
    return mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingles of a text, ASCII letters lower-cased; a shorter text is one shingle."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    h = word_hashes(found)
    if 0 < len(h) < k:
        return windows(h, len(h)) + np.uint64(len(h))
    return np.unique(windows(h, k))
