"""A compressed FM-index over many short texts, and matching statistics by backward search.

The texts are joined with separators, each its own symbol that sorts by position, so no two suffixes are equal. The index
is the Burrows-Wheeler transform in a wavelet matrix (packed bits with block counts), with the longest common prefixes
for shortening a match. All queries step together: each numpy operation serves one step of every query.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence; one packed bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        n = len(symbols)
        current = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = ((current >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bits, np.zeros(64 * (n // 64 + 2) - n, np.uint8)]), bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.blocks.append(counts)
            self.zeros.append(n - int(counts[-1]))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        every = np.arange(size)
        self.first = np.zeros(size, np.int64)
        self.first = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(codes: np.ndarray, size: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the longest common prefix of each with the one before, by prefix doubling.

    ``codes``: symbols below ``size``, separators 0, each of which sorts by its position. The first round packs several
    symbols into one key.
    """
    n = len(codes)
    bits = max(1, int(size - 1).bit_length())
    width = 8 if bits <= 7 else 4 if bits <= 15 else 2
    packed, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    for k in range(width):  # nothing counts behind a separator
        part = np.where(ended, 0, padded[k : k + n])
        ended |= part == 0
        packed = packed << bits | part
    order = np.argsort(packed, kind="stable")
    own = packed[order]
    # keys that hold a separator are equal only where the separators are different ones; a group's rank is its first slot
    fresh = np.ones(n, bool)
    fresh[1:] = (own[1:] != own[:-1]) | ended[order][1:]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
    levels, step = [rank.astype(np.int32)], width
    while True:
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(shared)  # only groups of more than one are sorted on
        if not len(slots):
            break
        if step > 2 * longest + width:
            raise AssertionError("suffixes that separators should tell apart are equal")
        part = order[slots]
        ahead = np.zeros(len(part), np.int64)
        inside = part + step < n
        ahead[inside] = rank[part[inside] + step] + 1
        key = rank[part] * (n + 1) + ahead
        by = np.argsort(key)
        part, key = part[by], key[by]
        order[slots] = part
        first = np.ones(len(part), bool)
        first[1:] = key[1:] != key[:-1]
        fresh[slots] = first
        rank[part] = np.maximum.accumulate(np.where(first, slots, 0))
        levels.append(rank.astype(np.int32))
        step *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        grown = same * (width << k)
        common[1:] += grown
        a, b = a + grown, b + grown
    alive = np.ones(n - 1, bool)
    for _ in range(width - 1):
        x, y = padded[np.minimum(a, n)], padded[np.minimum(b, n)]
        alive &= (x == y) & (x != 0)
        common[1:] += alive
        a, b = a + alive, b + alive
    return order, common


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; all pointers jump together."""
    at = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while True:
        open_ = open_[at[open_] >= 0]
        open_ = open_[values[at[open_]] >= values[open_]]
        if not len(open_):
            return at
        at[open_] = at[at[open_]]


class FMIndex:
    """texts: arrays of code points; owners: what each text belongs to."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray) -> None:
        self.lengths = np.asarray([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.lengths + 1)
        self.starts = ends - self.lengths - 1
        n = int(ends[-1])
        joined = np.zeros(n, np.int64)
        separators = np.zeros(n, bool)
        separators[ends - 1] = True
        joined[~separators] = np.concatenate(texts)
        letters, dense = np.unique(joined[~separators], return_inverse=True)
        self.symbols = np.zeros(n, np.int64)
        self.symbols[~separators] = dense + 1
        size = len(letters) + 1
        self.order, common = suffix_order(self.symbols, size, int(self.lengths.max(initial=1)) + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=size))])[:size]
        self.bwt = WaveletMatrix(self.symbols[self.order - 1], size)
        self.common = np.concatenate([common, [0]])
        self.common[0] = 0
        self.before = np.maximum(smaller_before(self.common), 0)
        self.behind = np.minimum(n - smaller_before(self.common[::-1].copy())[::-1], n)
        owner = np.repeat(owners, self.lengths + 1)[self.order]
        change = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        self.other = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]  # where the owner changes next
        self.n = n

    def shared(self, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and offset of every place from which ``least`` characters also stand in a text of another owner.

        Backward search from the end of each text: the match is extended to the left as long as its interval holds
        another owner, and shortened on the right to its parent interval otherwise.
        """
        at = self.starts[queries] + self.lengths[queries]
        first = self.starts[queries]
        name = queries
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        size = np.zeros(len(at), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            symbol = self.symbols[at - 1]
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            a, b = self.below[symbol] + both[: len(at)], self.below[symbol] + both[len(at) :]
            good = b > a
            good[good] = self.other[a[good]] < b[good]
            stuck = ~good & (size > 0)
            moved = ~stuck
            if stuck.any():
                lo, hi = low[stuck], high[stuck]
                left, right = self.common[lo], np.where(hi < self.n, self.common[hi], 0)
                deep = np.where(left >= right, lo, hi)
                depth = np.maximum(left, right)
                top = depth == 0
                low[stuck] = np.where(top, 0, self.before[deep])
                high[stuck] = np.where(top, self.n, self.behind[deep])
                size[stuck] = depth
            low[good], high[good] = a[good], b[good]
            size[good] += 1
            at = at - moved
            hit = moved & (size >= least)
            if hit.any():
                found.append((name[hit], at[hit] - first[hit]))
            # a match that is too short for the rest of its text can end here
            live = (at > first) & (size + (at - first) >= least)
            live |= (at > first) & ~moved
            if not live.all():
                at, first, name, low, high, size = at[live], first[live], name[live], low[live], high[live], size[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
