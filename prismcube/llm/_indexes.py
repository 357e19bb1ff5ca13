"""Text indexes over one shard, in numpy: suffix order, a wavelet matrix with its FM-index, and a bounded common-prefix expansion."""

from __future__ import annotations

import numpy as np

from ._common import ranges


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of symbols >= 1 with 0 as separator.  Separators count as different, in the order of their places,
    so that no common prefix reaches over one.  depth: no stretch between separators is longer."""
    n = len(symbols)
    top = max(int(symbols.max(initial=0)), 1)
    bits = top.bit_length()
    take = max(1, min(63 // bits, depth + 1))
    pad = np.zeros(n + take, np.int64)
    pad[:n] = symbols
    key = np.zeros(n, np.int64)
    over = np.zeros(n, bool)  # a separator has come
    for k in range(take):
        s = pad[k : k + n]
        over |= s == 0
        key = (key << bits) | np.where(over, 0, s)
    order = np.argsort(key, kind="stable")
    ks, os_ = key[order], over[order]
    new = np.ones(n, bool)
    new[1:] = (ks[1:] != ks[:-1]) | os_[1:] | os_[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    reach = take
    while reach <= depth and not new.all():
        # Only groups that are still tied are sorted again.
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        pos = order[at]
        nxt = pos + reach
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[pos]
        inner = np.lexsort((second, first))
        order[at] = pos[inner]
        f, s = first[inner], second[inner]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        new[at] = fresh
        rank[order] = np.cumsum(new) - 1
        reach *= 2
    return order


def burrows_wheeler(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = symbols[order - 1].copy()
    out[order == 0] = 0
    return out


class WaveletMatrix:
    """Rank of any symbol in any prefix; a packed bit vector with block counts for each bit of the symbols."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.words, self.blocks, self.zeros = [], [], []
        v = values
        for b in reversed(range(bits)):
            bit = (v >> b) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            ones = bit.astype(bool)
            self.zeros.append(int(self.n - ones.sum()))
            v = np.concatenate([v[~ones], v[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of the prefix ends `at` among the last level's entries; the difference of two of them is a count."""
        p = at
        for level, b in enumerate(reversed(range(self.bits))):
            inside = np.bitwise_count(self.words[level][p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))
            ones = self.blocks[level][p >> 6] + inside
            p = np.where((symbols >> b) & 1, self.zeros[level] + ones, p - ones)
        return p


class FMIndex:
    """Backward search over a Burrows-Wheeler transform that is kept as a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.order = suffix_array(symbols, depth)
        bwt = burrows_wheeler(symbols, self.order)
        top = int(symbols.max(initial=0))
        self.tree = WaveletMatrix(bwt, max(1, top.bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])  # symbols less than each
        every = np.arange(top + 1)
        self.base = self.tree.rank(every, np.zeros(top + 1, np.int64))

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.below[symbols] - self.base[symbols]
        return start + self.tree.rank(symbols, lo), start + self.tree.rank(symbols, hi)

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to the threshold n: for the queries symbols[:end], read backwards from each end, the
        length at which a match is alone in the index or n, and its interval.  Queries that are alone leave early."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order))
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(1, n + 1):
            a, b = self.extend(lo[live], hi[live], symbols[ends[live] - k])
            lo[live], hi[live], length[live] = a, b, k
            live = live[b - a > 1]
            if not len(live):
                break
        return length, lo, hi


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for many non-empty ranges."""
    size = hi - lo
    level = np.int64(np.log2(size)) if np.isscalar(size) else np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(lo), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def fm_repeats(symbols: np.ndarray, keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Places where n symbols begin that also begin at a place of a smaller key; symbols: >= 1, 0 separates."""
    inside = np.append(0, np.cumsum(symbols == 0))
    starts = np.arange(max(0, len(symbols) - n + 1))
    starts = starts[inside[starts + n] == inside[starts]]
    if not len(starts):
        return starts
    index = FMIndex(symbols, depth)
    length, lo, hi = index.statistics(symbols, starts + n, n)
    hit = np.flatnonzero((length == n) & (hi - lo > 1))
    least = least_in(keys[index.order], lo[hit], hi[hit])
    return starts[hit[least < keys[starts[hit]]]]


def bounded_prefixes(symbols: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Whether each suffix shares at least n symbols with the one before it in `order`.

    Breadth-first backward extension: the interval of a string w of length k is extended to the left by every symbol
    in it; where the right end of an interval that comes of it hasn't been met, the common prefix there is k, and the
    interval is extended in its turn.  Prefixes so come by increasing value, and the search stops at n.  A level's
    intervals are disjoint; their rows, taken stably by symbol, are the rows of the extended intervals.
    """
    size = len(symbols)
    bwt = burrows_wheeler(symbols, order)
    narrow = bwt.astype(np.uint16) if int(bwt.max(initial=0)) < 1 << 16 else bwt
    back = np.empty(size, np.int64)
    back[np.argsort(narrow, kind="stable")] = np.arange(size)
    open_ = np.ones(size + 1, bool)
    open_[[0, size]] = False
    # Separators are strings of their own: each of their suffixes is met with a common prefix of 0.
    seps = int((symbols == 0).sum())
    open_[: seps + 1] = False
    lo, hi = np.array([0]), np.array([size])
    for level in range(n):
        count = hi - lo
        rows = ranges(lo, count)
        which = np.repeat(np.arange(len(lo)), count)
        c = narrow[rows]
        some = c != 0
        rows, which, c = rows[some], which[some], c[some]
        by = np.argsort(c, kind="stable")
        rows, which, c = rows[by], which[by], c[by]
        if len(rows):
            head = np.ones(len(rows), bool)
            head[1:] = (which[1:] != which[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(rows)) - 1
            lo, hi = back[rows[first]], back[rows[last]] + 1
            new = open_[hi]
            lo, hi = lo[new], hi[new]
            open_[hi] = False
        else:
            lo = hi = np.zeros(0, np.int64)
        if not level:
            lo, hi = np.append(lo, np.arange(seps)), np.append(hi, np.arange(1, seps + 1))
        if not len(lo):
            break
    return open_[:size]


def bwt_repeats(symbols: np.ndarray, keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The same as fm_repeats, from the bounded common prefixes."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order = suffix_array(symbols, depth)
    same = bounded_prefixes(symbols, order, n)
    inside = same.copy()
    inside[:-1] |= same[1:]
    at = np.flatnonzero(inside)
    if not len(at):
        return at
    pos = order[at]
    heads = np.flatnonzero(~same[at])
    least = np.minimum.reduceat(keys[pos], heads)
    least = np.repeat(least, np.diff(np.append(heads, len(at))))
    return np.sort(pos[least < keys[pos]])
