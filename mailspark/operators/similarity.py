"""Similarity of two long texts by their matching blocks.

The verdict is that of ``difflib.SequenceMatcher(None, a, b, False).ratio() >= t``:
the longest common block (of equal ones the first in ``a``, then in ``b``), then the
same on both sides of it. The longest block of a range is found on the ranks of all
substrings of length 1, 2, 4, ..., which are the rounds of prefix doubling over both
texts; two substrings of any length are equal if the ranks of their first and last
2^k characters are. A search over lengths therefore takes a few passes over the
range where a comparison of all places takes their product.

Ranks cost a sort of both texts per round, so hashes of substrings, modulo 2^64 from
prefix sums, search first. Equal substrings have equal hashes: a length at which no
hashes meet is too long. The block found is compared character by character, and only
if that fails, because different substrings met by chance, the ranks decide.
"""

from __future__ import annotations

import difflib
import heapq
from collections import Counter

import numpy as np

# Ranges with at most this many pairs of places are compared place by place.
_SMALL = 1 << 14


class _Hashes:
    """Hashes of all substrings of two texts."""

    _BASE = 0x9E3779B97F4A7C15
    _INVERSE = pow(_BASE, -1, 1 << 64)

    def __init__(self, a: str, b: str):
        self.a, self.b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
        most = max(len(a), len(b)) + 1
        powers = _powers(self._BASE, most)
        # Brought back to the power 0, so that a hash does not depend on the place.
        self.back = _powers(self._INVERSE, most)
        # Characters are mixed, so that sums of neighbouring codes do not meet.
        self.sums = []
        for codes in (self.a, self.b):
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.sums.append(np.append(np.uint64(0), np.cumsum(mixed * powers[:len(codes)], dtype=np.uint64)))

    def _of(self, side: int, low: int, high: int, length: int) -> np.ndarray:
        sums = self.sums[side]
        return (sums[low + length:high + 1] - sums[low:high + 1 - length]) * self.back[low:high + 1 - length]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
        """``i, j, length`` of the longest common block; None if hashes do not tell."""
        low, high = 0, min(ahi - alo, bhi - blo)
        while low < high:
            middle = (low + high + 1) // 2
            x, y = self._of(0, alo, ahi, middle), np.sort(self._of(1, blo, bhi, middle))
            x = np.sort(x)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if (y[at] == x).any():
                low = middle
            else:
                high = middle - 1
        if low == 0:
            return alo, blo, 0
        x, y = self._of(0, alo, ahi, low), self._of(1, blo, bhi, low)
        i = int(np.argmax(np.isin(x, y)))
        j = int(np.argmax(y == x[i]))
        i, j = alo + i, blo + j
        return (i, j, low) if np.array_equal(self.a[i:i + low], self.b[j:j + low]) else None


def _powers(base: int, number: int) -> np.ndarray:
    """``base ** k`` modulo 2^64 for k from 0, by doubling."""
    found = np.ones(1, dtype=np.uint64)
    while len(found) < number:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
    return found[:number]


def bound_reaches(a: str, b: str, threshold: float) -> bool:
    """Whether ``SequenceMatcher.quick_ratio()``, by the characters both have, reaches
    the threshold."""
    total = len(a) + len(b)
    if not total:
        return threshold <= 1.0
    both = (Counter(a) & Counter(b)).total()
    return 2.0 * both / total >= threshold


class _Ranks:
    """Ranks of the substrings of length 2^k, level by level as they are needed."""

    def __init__(self, a: str, b: str):
        codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.shift = len(a)
        self._levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]

    def level(self, k: int) -> np.ndarray:
        while len(self._levels) <= k:
            last, half = self._levels[-1], 1 << (len(self._levels) - 1)
            pairs = last[:-half] * len(last) + last[half:]
            self._levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        return self._levels[k]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """``i, j, length`` of the longest common block of a[alo:ahi] and b[blo:bhi]."""
        most = min(ahi - alo, bhi - blo)
        x, y = np.arange(alo, ahi), np.arange(blo, bhi) + self.shift

        def common(length: int, name):
            """The places left at which a block of this length occurs in both."""
            at, to = x[x + length <= ahi], y[y + length <= bhi + self.shift]
            name_x, name_y = name(at), name(to)
            hit = np.isin(name_x, name_y)
            return at[hit], to[np.isin(name_y, name_x[hit])]

        k = 0
        while 1 << k <= most:
            ranks = self.level(k)
            at, to = common(1 << k, lambda p: ranks[p])
            if len(at) == 0:
                break
            x, y, k = at, to, k + 1
        if k == 0:
            return alo, blo, 0
        ranks = self.level(k - 1)
        low, high = 1 << (k - 1), min((1 << k) - 1, most)

        def named(length: int):
            return lambda p: ranks[p] * len(ranks) + ranks[p + length - (1 << (k - 1))]

        while low < high:
            middle = (low + high + 1) // 2
            at, to = common(middle, named(middle))
            if len(at):
                x, y, low = at, to, middle
            else:
                high = middle - 1
        name = named(low)
        x, y = x[x + low <= ahi], y[y + low <= bhi + self.shift]
        j = y[np.argmax(name(y) == name(x[:1]))]
        return int(x[0]), int(j) - self.shift, low


def alike(a: str, b: str, threshold: float) -> bool:
    """Whether the matching blocks of two texts reach the ratio ``threshold``.

    The widest open range goes first, and the search ends as soon as what has
    matched, or what could still match, decides.
    """
    total = len(a) + len(b)
    if not total:
        return threshold <= 1.0
    hashes, ranks, matched, possible = _Hashes(a, b), None, 0, min(len(a), len(b))
    open_ = [(-possible, 0, len(a), 0, len(b))]
    while open_:
        if 2.0 * matched / total >= threshold:
            return True
        if 2.0 * (matched + possible) / total < threshold:
            return False
        width, alo, ahi, blo, bhi = heapq.heappop(open_)
        possible += width
        if (ahi - alo) * (bhi - blo) <= _SMALL:
            part = difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], False)
            matched += sum(block.size for block in part.get_matching_blocks())
            continue
        found = hashes.longest(alo, ahi, blo, bhi)
        if found is None:
            ranks = ranks or _Ranks(a, b)
            found = ranks.longest(alo, ahi, blo, bhi)
        i, j, n = found
        if n == 0:
            continue
        matched += n
        for side in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
            width = min(side[1] - side[0], side[3] - side[2])
            if width:
                possible += width
                heapq.heappush(open_, (-width, *side))
    return 2.0 * matched / total >= threshold
