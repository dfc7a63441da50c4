"""Hashes of words and word k-grams, winnowing by leftmost minima, and interval unions."""

from __future__ import annotations

import numpy as np

CACHED, LONGEST = 400_000, 64
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHasher:
    """XXH64 of words as an array, through a bounded cache."""

    def __init__(self) -> None:
        from xxhash import xxh64_intdigest

        self.cache: dict[bytes, int] = {}
        self.hash = xxh64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        extra: dict[bytes, int] = {}
        for w in set(words).difference(cache):
            (cache if len(w) <= LONGEST else extra)[w] = self.hash(w)
        found = (extra[w] if w in extra else cache[w] for w in words) if extra else map(cache.__getitem__, words)
        return np.fromiter(found, np.uint64, len(words))


_HASHER = WordHasher()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _HASHER(words)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; of length 0 if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _FACTOR
        acc += hashes[j : j + n]
    acc ^= acc >> np.uint64(32)
    acc *= _MIX
    acc ^= acc >> np.uint64(29)
    return acc


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its minimum, the leftmost of equal ones."""
    if len(values) < width:
        return np.empty(0, np.int64)
    place, least, span = np.arange(len(values)), values, 1
    while span < width:
        d = min(span, width - span)
        a, b = least[:-d], least[d:]
        place = np.where(b < a, place[d:], place[:-d])
        least = np.minimum(a, b)
        span += d
    return place


def distinct_sorted(places: np.ndarray) -> np.ndarray:
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n places the half-open spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s, e in spans:
        edge[s] += 1
        edge[e] -= 1
    return np.cumsum(edge[:n]) > 0
