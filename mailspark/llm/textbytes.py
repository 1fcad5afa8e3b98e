"""Words and word shingles of UTF-8 bytes as numpy arrays, for use inside tasks.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return, with A-Z lower-cased. All of these are ASCII, so
bytes and characters give the same words.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = 1 << 12


def _powers(base: int) -> np.ndarray:
    out = np.empty(_STEPS, dtype=np.uint64)
    value = 1
    for i in range(_STEPS):
        out[i] = value
        value = value * base & 0xFFFFFFFFFFFFFFFF
    return out


_POWER = _powers(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = word_bounds(data)
    if len(starts) == 0:
        return np.empty(0, dtype=np.uint64)
    # Position within the word, so that equal words weigh their bytes equally.
    lengths = ends - starts
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bytes_ = data[np.repeat(starts, lengths) + within].astype(np.uint64) + np.uint64(1)
    weights = _POWER[within % _STEPS]
    if lengths.max() > _STEPS:
        # Very long words: each further stretch of bytes is scrambled by its number.
        weights = mix(weights + (within // _STEPS).astype(np.uint64) * np.uint64(_BASE_INVERSE))
    sums = np.add.reduceat(mix(bytes_ * weights), np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(_BASE))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles.

    A text with fewer words has its whole sequence as the one shingle; a text
    without words has none.
    """
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if len(words) == 0:
        return words
    width = min(width, len(words))
    rows = len(words) - width + 1
    value = np.full(rows, width, dtype=np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(_BASE) + words[k:k + rows])
    return np.unique(value)
