"""FM-index over whole-number symbols: a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet
matrix whose bits are compressed by runs, and backward search for many patterns at once; a pair of them, over a text and over the
text backward, extends many patterns by a symbol at either end."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits in words of 64 with the ones before each: rank in two look-ups. Words of one sign only, as runs of the transform make
    them, are kept once for all."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32)
        full = np.uint64((1 << 64) - 1)
        mixed = (words != 0) & (words != full)
        self.slot = np.where(mixed, np.cumsum(mixed) + 1, words == full).astype(np.int32)
        self.words = np.concatenate((np.array([0, full], np.uint64), words[mixed]))
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[self.slot[word]] & mask)

    def nbytes(self) -> int:
        return self.before.nbytes + self.slot.nbytes + self.words.nbytes


class FmIndex:
    def __init__(self, text: np.ndarray, depth: int) -> None:
        """text: symbols from 0. Suffixes are sorted by their first `depth` symbols at least; patterns may be as long."""
        n, bits = len(text), max(1, int(text.max()).bit_length())
        h = max(1, min(62 // bits, depth))  # so many symbols fit into the first key
        key = np.zeros(n, np.int64)
        for k in range(h):
            key <<= bits
            key[: n - k] |= text[k:]
        while True:
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            if h >= depth or rank[order[-1]] == n - 1:
                break
            key = rank * (n + 2)
            key[: max(0, n - h)] += rank[h:] + 1
            h *= 2
        last = text[order - 1]
        self.n, self.levels = n, bits
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.tree = []
        for level in reversed(range(self.levels)):
            bits = (last >> level & 1).astype(np.uint8)
            self.tree.append(Bits(bits))
            last = np.concatenate((last[bits == 0], last[bits == 1]))

    def nbytes(self) -> int:
        return self.before.nbytes + sum(b.nbytes() for b in self.tree)

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transform."""
        start = np.zeros(len(i), np.int64)
        for level, bits in zip(reversed(range(self.levels)), self.tree):
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start = np.where(one, bits.zeros + a, start - a)
            i = np.where(one, bits.zeros + b, i - b)
        return i - start

    def matching(self, text: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Of the places `ends` in text, the matching statistic: how many symbols, up to `length`, read backward from there
        occur at least `least` times in the index."""
        found = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        symbol = text[ends]
        low, high = self.before[symbol], self.before[symbol + 1]
        for step in range(1, length + 1):
            on = high - low >= least
            live, low, high = live[on], low[on], high[on]
            found[live] = step
            if step == length or not len(live):
                break
            symbol = text[ends[live] - step]
            both = self.occurrences(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            low, high = self.before[symbol] + both[: len(live)], self.before[symbol] + both[len(live) :]
        return found

    def starts(self) -> np.ndarray:
        """Where each symbol's places begin below the last level of the wavelet matrix."""
        symbols = np.arange(len(self.before) - 1)
        at = np.zeros(len(symbols), np.int64)
        for level, bits in zip(reversed(range(self.levels)), self.tree):
            ones = bits.rank(at)
            at = np.where(symbols >> level & 1, bits.zeros + ones, at - ones)
        return at

    def extensions(self, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol in each range [low, high) of the transform, as (range, symbol, occurrences before the range, occurrences in
        the range, smaller symbols in the range): all ranges go down the wavelet matrix together and split where both bits occur."""
        owner, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for bits in self.tree:
            a, b = bits.rank(low), bits.rank(high)
            zeros = (high - b) - (low - a)
            left, right = zeros > 0, b > a
            owner = np.concatenate((owner[left], owner[right]))
            symbol = np.concatenate((symbol[left] << 1, symbol[right] << 1 | 1))
            smaller = np.concatenate((smaller[left], smaller[right] + zeros[right]))
            low, high = np.concatenate((low[left] - a[left], bits.zeros + a[right])), np.concatenate((high[left] - b[left], bits.zeros + b[right]))
        return owner, symbol, low - starts[symbol], high - low, smaller

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(occurrences before the range, occurrences in it, smaller symbols in it) of one symbol for each range."""
        start, smaller = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for level, bits in zip(reversed(range(self.levels)), self.tree):
            one = (symbol >> level & 1).astype(bool)
            s, a, b = bits.rank(start), bits.rank(low), bits.rank(high)
            smaller += np.where(one, (high - b) - (low - a), 0)
            start, low, high = (np.where(one, bits.zeros + r, x - r) for x, r in ((start, s), (low, a), (high, b)))
        return low - start, high - low, smaller


class Patterns:
    """Patterns of a TwoWayIndex: their symbols, first to last, as columns; where their suffixes begin among those of the text, and
    those of the pattern backward among those of the text backward; how often each occurs."""

    def __init__(self, symbols: list[np.ndarray], low: np.ndarray, back: np.ndarray, n: np.ndarray) -> None:
        self.symbols, self.low, self.back, self.n = symbols, low, back, n

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, which: np.ndarray | slice) -> "Patterns":
        return Patterns([s[which] for s in self.symbols], self.low[which], self.back[which], self.n[which])


class TwoWayIndex:
    """Bidirectional FM-index. Symbol 0 parts the text, which begins and ends with it, and is in no pattern; patterns have `depth`
    symbols at most. Extending at one end is a step in that end's transform; at the other end the range shrinks by the smaller symbols
    beside it."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.ahead, self.behind = FmIndex(text, depth), FmIndex(text[::-1], depth)
        self.starts, self.starts_behind = self.ahead.starts(), self.behind.starts()

    def symbols(self) -> Patterns:
        """The patterns of one symbol."""
        before = self.ahead.before
        found = np.flatnonzero(np.diff(before))
        found = found[found > 0]
        return Patterns([found], before[found], before[found], before[found + 1] - before[found])

    def right(self, p: Patterns) -> Patterns:
        """All patterns that go on from p by one symbol."""
        of, symbol, before, n, smaller = self.behind.extensions(p.back, p.back + p.n, self.starts_behind)
        on = symbol > 0
        of, symbol, before, n, smaller = of[on], symbol[on], before[on], n[on], smaller[on]
        return Patterns([*(s[of] for s in p.symbols), symbol], p.low[of] + smaller, self.behind.before[symbol] + before, n)

    def left(self, p: Patterns) -> Patterns:
        """All patterns that lead to p by one symbol."""
        of, symbol, before, n, smaller = self.ahead.extensions(p.low, p.low + p.n, self.starts)
        on = symbol > 0
        of, symbol, before, n, smaller = of[on], symbol[on], before[on], n[on], smaller[on]
        return Patterns([symbol, *(s[of] for s in p.symbols)], self.ahead.before[symbol] + before, p.back[of] + smaller, n)

    def right_by(self, p: Patterns, symbol: np.ndarray) -> Patterns:
        """Each pattern of p with one symbol after it; those that don't occur have n = 0."""
        before, n, smaller = self.behind.step(symbol, p.back, p.back + p.n)
        return Patterns([*p.symbols, symbol], p.low + smaller, self.behind.before[symbol] + before, n)
