"""An FM-index over a sequence of integers: suffix array, wavelet matrix of its transform, sampled positions.

All operations take arrays and work on many patterns at once.
"""

from __future__ import annotations

import numpy as np

#: Symbols below this are set aside: 0 ends the sequence, 1 separates its parts.
END, SEPARATOR, FIRST = 0, 1, 2


def _kind(most: int) -> type[np.signedinteger]:
    """Numbers up to ``most`` in four bytes if they fit."""
    return np.int32 if most < 1 << 31 else np.int64


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling. Separators count as different and rising, so no comparison crosses one.

    The first sort compares as many symbols as fit into 62 bits; later ones only suffixes that are still tied.
    """
    n = len(seq)
    kind = _kind(n)
    separators = seq == SEPARATOR
    key = seq.astype(np.int64)
    key += int(separators.sum()) + 1
    key[separators] = np.arange(1, int(separators.sum()) + 1)
    key[-1] = 0
    bits = max(1, int(key.max()).bit_length())
    step = min(n, max(1, 62 // bits))
    symbol = key.astype(_kind(int(key.max())))
    for i in range(1, step):  # behind the end stand zeros, less than any symbol
        key <<= bits
        key[: n - i] |= symbol[i:]
    del symbol, separators
    order = np.argsort(key, kind="stable").astype(kind)
    ordered = key[order]
    del key
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del ordered
    begins = np.where(first, np.arange(n, dtype=kind), kind(0))
    rank = np.empty(n, kind)  # the place where a suffix's group of tied ones begins
    rank[order] = np.maximum.accumulate(begins, out=begins)
    del begins
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at = order[tied].astype(np.int64)
        behind = at + step
        key = np.where(behind < n, rank[np.minimum(behind, n - 1)] + np.int64(1), 0)
        del behind
        key += rank[at] * np.int64(n + 1)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2


class Bits:
    """A bit vector with counts of the ones before any position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(64 - n % 64, bits.dtype)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: rank of any symbol, and symbol with its rank at any position."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        now = seq
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (now >> shift) & 1 != 0
            self.levels.append((shift, Bits(ones), int(len(now) - ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i falls behind the last level on the way of the symbol."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 != 0, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and where these fall behind the last level."""
        symbol = np.zeros(len(i), np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.at(i), bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """seq: symbols from FIRST on, parts separated by SEPARATOR; no pattern may hold a separator."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        seq = np.append(seq, END).astype(_kind(int(seq.max(initial=0))), copy=False)
        self.n = n = len(seq)
        order = suffix_array(seq)
        self.top = int(seq.max())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.top + 1))])
        self.wavelet = Wavelet(seq[order - 1], self.top)
        symbols = np.arange(self.top + 1)
        self.start = self.wavelet.down(symbols, np.zeros(self.top + 1, np.int64))
        # positions after a separator are kept too, so that no walk has to cross one
        keep = (order % sample == 0) | (seq[order - 1] == SEPARATOR)
        self.kept, self.places = Bits(keep), order[keep]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbols stand before positions i of the transform."""
        return self.wavelet.down(symbol, i) - self.start[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo <= r < hi of the suffixes that begin with each pattern (one a row), by backward search."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.flatnonzero((patterns <= self.top).all(axis=1))
        hi[(patterns > self.top).any(axis=1)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix rows: walk back to the next kept position."""
        out = np.empty(len(rows), np.int64)
        todo, now, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            kept = self.kept.at(now)
            out[todo[kept]] = self.places[self.kept.rank(now[kept])] + steps
            todo, now = todo[~kept], now[~kept]
            symbol, down = self.wavelet.access(now)
            now = self.less[symbol] + down - self.start[symbol]
            steps += 1
        return out
