"""Hashed n-grams of code points within words, for a whole text at once."""

from __future__ import annotations

import numpy as np

_K, _M = np.uint32(0x01000193), np.uint32(0x85EBCA6B)


def spaced(words: list[str]) -> np.ndarray:
    """Code points of the words with one blank before, between and behind them: a blank marks both ends of a word."""
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(points: np.ndarray, shortest: int, longest: int, seed: int = 0):
    """(n, 32-bit hashes of the n-grams that start at each place) for each n."""
    h = (points[: max(0, len(points) - shortest + 1)] + np.uint32(seed)) * _M
    for j in range(1, shortest):
        h = (h ^ (h >> np.uint32(15))) * _K + points[j : len(points) - shortest + 1 + j] * _M
    for n in range(shortest, longest + 1):
        x = (h ^ (h >> np.uint32(16))) * _M
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        yield n, x ^ (x >> np.uint32(16))
        if len(points) <= n:
            h = h[:0]
            continue
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _K + points[n:] * _M


def places(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word where the blank before it and the one behind it are."""
    blanks = np.flatnonzero(points == 32)
    return blanks[:-1], blanks[1:]


def inside(first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the range of places at which an n-gram lies within it and its blanks; empty for words too short."""
    return first, np.maximum(first, last - n + 2)
