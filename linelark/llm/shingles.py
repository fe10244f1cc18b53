"""Vectorised hashing of word shingles over raw UTF-8 buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer texts are cut at white space.
SEGMENT = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z hash like a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(SEGMENT + 2)


def _words(buffer: np.ndarray) -> np.ndarray:
    """64-bit hashes of the white-space separated words of at most SEGMENT bytes."""
    space = np.empty(len(buffer) + 2, bool)
    space[0] = space[-1] = True
    np.take(_SPACE, buffer, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * _UP[: len(buffer)], out=total[1:])
    return mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buffer: np.ndarray) -> np.ndarray:
    """As ``_words`` for any length: cut at the last white space of each segment; a longer word is hashed as chained parts."""
    if len(buffer) <= SEGMENT:
        return _words(buffer)
    parts, at = [], 0
    while at < len(buffer):
        end = min(at + SEGMENT, len(buffer))
        if end < len(buffer):
            gaps = np.flatnonzero(_SPACE[buffer[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word of over SEGMENT bytes: fold its parts into one hash
                stop = end
                while stop < len(buffer) and not _SPACE[buffer[stop]]:
                    stop += 1
                whole = np.uint64(0)
                for a in range(at, stop, SEGMENT):
                    with np.errstate(over="ignore"):
                        whole = mix(np.array([whole * _PLACE[0] + _words(buffer[a : min(a + SEGMENT, stop)])[0]], np.uint64))[0]
                parts.append(np.array([whole], np.uint64))
                at = stop
                continue
        parts.append(_words(buffer[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(buffer: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``k`` consecutive words; fewer words: the whole sequence as one; none: empty."""
    w = word_hashes(buffer)
    if not len(w):
        return w
    n = min(k, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * _PLACE[j]
    return np.unique(mix(total))


def text_buffers(column: pa.Array):
    """(row's bytes as an array, or None) of a string column, without making Python strings."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_pylist()
    for i in range(len(column)):
        yield raw[ends[i] : ends[i + 1]] if valid[i] else None
