"""FM-index over word codes: a wavelet matrix of packed bits and symbol counts, searched for many patterns at once.

The suffix array exists only while the index is built; what stays is the Burrows-Wheeler
transform in a wavelet matrix (a bit per level and symbol, and a count per 64 bits), the
number of smaller symbols, and the intervals of all short runs of ``jump`` symbols, from
which every backward search starts.  The suffix order covers the first ``depth`` symbols,
which is all that patterns of up to ``depth`` symbols need.
"""

from __future__ import annotations

import numpy as np

#: Patterns that take a step together; the arrays of a step stay in the processor's cache.
_TOGETHER = 1 << 15


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of integer keys, equal keys having equal ranks."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.empty(len(keys), np.int64)
    step = np.ones(len(keys), np.int64)
    step[:1] = 0
    step[1:] = s[1:] != s[:-1]
    rank[order] = np.cumsum(step)
    return rank


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """Rank ``by`` places on, 0 past the end."""
    out = np.zeros(len(rank), np.int64)
    if by < len(rank):
        out[: len(rank) - by] = rank[by:] + 1
    return out


def _packed(text: np.ndarray, levels: int, count: int) -> np.ndarray:
    """At each place the next ``count`` symbols in one integer, with 0 past the end."""
    out = np.zeros(len(text), np.int64)
    for i in range(count):
        out <<= levels
        out[: len(text) - i] |= text[i:]
    return out


class WaveletMatrix:
    """Symbols below ``1 << levels`` with rank queries."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.bits, self.before, self.zeros = [], [], []
        x = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1])).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends inside the symbol's run on the last level."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][word] + np.bitwise_count(self.bits[i][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """Index of ``text`` (int symbols from 1 up, 0 between pieces) for patterns of up to ``depth`` symbols without 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.n = depth, len(text)
        text = text.astype(np.int64)
        self.sigma = int(text.max(initial=0)) + 1
        self.level_bits = levels = max(1, int(self.sigma - 1).bit_length())
        self.jump = min(depth, 62 // levels)
        # Doubling: ranks by as many symbols as one integer holds, then by twice as many; the last step overlaps to reach the depth.
        start = _packed(text, levels, self.jump)
        rank, known = _dense(start), self.jump
        while 2 * known < depth:
            rank, known = _dense(rank * (self.n + 2) + _shifted(rank, known)), 2 * known
        suffixes = np.argsort(rank * (self.n + 2) + _shifted(rank, depth - known))
        self.runs, self.run_lo = np.unique(start[suffixes], return_index=True)
        self.run_hi = np.append(self.run_lo[1:], self.n)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.bits = WaveletMatrix(text[suffixes - 1].astype(np.int32), levels)
        self.base = self.first[:-1] - self.bits.walk(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns of ``lo, hi`` with ``symbol`` before them: one step of backward search."""
        out_lo, out_hi = np.empty_like(lo), np.empty_like(hi)
        for i in range(0, len(lo), _TOGETHER):
            s = slice(i, i + _TOGETHER)
            c = symbol[s]
            both = self.bits.walk(np.concatenate([c, c]), np.concatenate([lo[s], hi[s]]))
            base = self.base[c]
            out_lo[s], out_hi[s] = both[: len(c)] + base, both[len(c) :] + base
        return out_lo, out_hi

    def statistics(self, stream: np.ndarray, end: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of a stream at the places ``end`` (exclusive), up to the index's depth.

        For each place the largest number of symbols before it that occur ``least`` times or more in the index, as far as it is
        ``jump`` or more (0 below), and the first place of their interval, which tells equal matches of one length apart from others.
        A 0 or a symbol that the index lacks ends a match.  Places that share an interval and the next symbol take the step together.
        """
        length, found = np.zeros(len(end), np.int64), np.full(len(end), -1, np.int64)
        stream = np.where(stream < self.sigma, stream, 0).astype(np.int64)
        packed = _packed(stream, self.level_bits, self.jump)
        active = np.flatnonzero(end >= self.jump)
        want = packed[end[active] - self.jump]
        spot = np.minimum(np.searchsorted(self.runs, want), max(0, len(self.runs) - 1))
        low = (1 << self.level_bits) - 1
        whole = np.ones(len(active), bool)
        for i in range(self.jump):
            whole &= (want >> (i * self.level_bits)) & low > 0
        held = whole & (self.runs[spot] == want) & (self.run_hi[spot] - self.run_lo[spot] >= least) if len(self.runs) else np.zeros(len(active), bool)
        active, spot = active[held], spot[held]
        state, which = np.unique(spot, return_inverse=True)
        lo, hi = self.run_lo[state].astype(np.int64), self.run_hi[state].astype(np.int64)
        length[active], found[active] = self.jump, lo[which]
        for size in range(self.jump + 1, self.depth + 1):
            at = end[active] - size
            symbol = np.where(at >= 0, stream[np.maximum(at, 0)], 0)
            pair, which = np.unique(which * self.sigma + symbol, return_inverse=True)
            c = pair % self.sigma
            lo, hi = self.extend(c, lo[pair // self.sigma], hi[pair // self.sigma])
            good = (c > 0) & (hi - lo >= least)
            number = np.cumsum(good) - 1
            keep = good[which]
            active, which = active[keep], number[which[keep]]
            lo, hi = lo[good], hi[good]
            if not len(active):
                break
            length[active], found[active] = size, lo[which]
        return length, found
