"""A compressed FM-index over word sequences: suffix array, BWT, wavelet matrix.

The wavelet matrix keeps one bit per symbol and level in 64-bit words with a
running count per word; least values of row ranges take three numbers a row. Searches run for many patterns at once, in lockstep.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))]).astype(np.int32)
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)


class Minima:
    """Least values of ranges of an array, in about three numbers a value.

    Running minima from both ends of each block of 64, and a table of doubling ranges
    over whole blocks; ranges within a block are read off the values.
    """

    def __init__(self, values: np.ndarray) -> None:
        n, top = len(values), np.iinfo(values.dtype).max
        block = np.full((-(-n // 64), 64), top, values.dtype)
        block.ravel()[:n] = values
        self.values = block.ravel()
        self.ahead = np.minimum.accumulate(block, axis=1).ravel()
        self.behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [block.min(1)]
        while 2 << (len(self.table) - 1) <= len(block):
            t, h = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[: len(t) - h], t[h:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value in lo..hi-1 (lo < hi)."""
        last = hi - 1
        a, b = lo >> 6, last >> 6
        out = np.minimum(self.behind[lo], self.ahead[last])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            k = np.frexp((b[far] - a[far] - 1).astype(np.float64))[1] - 1
            for level in np.unique(k):
                at, t = far[k == level], self.table[level]
                out[at] = np.minimum(out[at], np.minimum(t[a[at] + 1], t[b[at] - (1 << int(level))]))
        near = np.flatnonzero(a == b)
        size = hi[near] - lo[near]
        for low, most in ((0, 1), (1, 4), (4, 16), (16, 64)):
            at = near[(size > low) & (size <= most)]
            if len(at):
                i = np.minimum(lo[at, None] + np.arange(most), last[at, None])
                out[at] = self.values[i].min(1)
        return out


def suffix_array(first: np.ndarray, longest: int) -> np.ndarray:
    """Suffix order of a sequence of ranks, by prefix doubling until suffixes differ or ``longest`` symbols are compared."""
    n = len(first)
    rank, h = first.astype(np.int64), 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - h] = rank[h:]
        key = rank * (n + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        step = np.zeros(n, np.int64)
        step[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        new[order] = step
        rank, h = new, 2 * h
        if step[-1] == n - 1 or h > 2 * longest:
            return order


class FMIndex:
    """Index of a list of sequences, each with a value; finds the least value among a pattern's occurrences.

    Symbols that occur in one sequence only share a code that no search matches,
    for a match beside the sequence itself is what is asked for.
    """

    def __init__(self, seqs: list[np.ndarray], values: np.ndarray) -> None:
        lengths = np.array([len(s) for s in seqs])
        m = len(seqs)
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        n = int(lengths.sum()) + m
        flat = np.concatenate(seqs)
        names, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(m), lengths)
        lo = np.full(len(names), m, np.int64)
        hi = np.zeros(len(names), np.int64)
        np.minimum.at(lo, code, owner)
        np.maximum.at(hi, code, owner)
        common = lo < hi
        small = np.where(common, np.cumsum(common) + 1, 1)  # 0: end of a sequence, 1: own to one sequence
        place = np.arange(len(flat)) + owner
        self.text = np.zeros(n, np.int64)
        self.text[place] = small[code]
        full = np.empty(n, np.int64)  # ends differ from one another and sort first
        full[place] = m + code
        full[self.start + lengths] = np.arange(m)
        sa = suffix_array(full, int(lengths.max()) + 1)
        # Own symbols sort by name in the suffix array but share a code; they are never searched, so only codes above count.
        order_code = np.where(common, np.cumsum(common) + 1, 1)
        self.sigma = int(order_code.max()) + 1
        bwt = self.text[sa - 1]
        first = self.text[sa]
        self.first_row = np.full(self.sigma, n, np.int64)
        np.minimum.at(self.first_row, first, np.arange(n))
        # Rows of one code are contiguous for searched codes, as those are single symbols.
        self.levels: list[Bits] = []
        self.bits = max(1, int(self.sigma - 1).bit_length())
        cur = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.zone = self._walk(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        seq_of = np.searchsorted(self.start, sa, side="right") - 1
        self.least = Minima(values[seq_of].astype(np.int32))
        self.text = self.text.astype(np.int32)
        self.n = n

    def _walk(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels):
            one = level.rank(i)
            i = np.where((sym >> b) & 1, level.zeros + one, i - one)
        return i

    def extend(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of sym + pattern from the rows of each pattern."""
        k = len(sym)
        both = self._walk(np.concatenate([sym, sym]), np.concatenate([lo, hi])) - np.concatenate([self.zone[sym]] * 2)
        return self.first_row[sym] + both[:k], self.first_row[sym] + both[k:]

    def reach(self, end: np.ndarray, stop: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Matching statistics at text places ``end``, to the left.

        The least p >= stop such that text[p:end] occurs in a sequence whose value is less than ``below``.
        """
        p = end.copy()
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        live = np.flatnonzero(p > stop)
        while len(live):
            sym = self.text[p[live] - 1]
            known = sym > 1
            live, sym = live[known], sym[known]
            if not len(live):
                break
            a, b = self.extend(sym, lo[live], hi[live])
            ok = a < b
            live, a, b = live[ok], a[ok], b[ok]
            if not len(live):
                break
            ok = self.least.of(a, b) < below[live]
            live, a, b = live[ok], a[ok], b[ok]
            lo[live], hi[live] = a, b
            p[live] -= 1
            live = live[p[live] > stop[live]]
        return p

    def windows(self, which: np.ndarray, count: np.ndarray, below: np.ndarray, width: int) -> list[tuple[int, int, int]]:
        """(i, first, last): runs of windows of sequence ``which[i]`` that occur in a sequence of a value less than below[i].

        Every search settles several windows: a match all those inside it, a
        failure all those around the words that failed.
        """
        out: list[tuple[int, int, int]] = []
        i = np.arange(len(which))
        a, b = np.zeros(len(which), np.int64), count.astype(np.int64) - 1
        x = b.copy()
        while len(i):
            s = self.start[which[i]]
            p = self.reach(s + x + width, s + a, below[i]) - s
            good = p <= x
            out += zip(i[good].tolist(), p[good].tolist(), x[good].tolist())
            left_b = np.where(good, p - 1, x - 1)
            right_a = np.where(good, x + 1, p)
            i, a, b = np.concatenate([i, i]), np.concatenate([a, right_a]), np.concatenate([left_b, b])
            ok = a <= b
            i, a, b = i[ok], a[ok], b[ok]
            x = (a + b) // 2
        return out
