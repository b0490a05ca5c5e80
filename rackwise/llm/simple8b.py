"""Simple-8b: whole numbers packed into 64-bit words, as many as fit. A word has a 4-bit selector in its low bits and 60 bits
of values. Selectors 0 to 13 say how many values of how many bits there are; 15 is the escape: the next word is one raw
64-bit value. Blocks of fixed count start at stated words, so they are packed side by side and unpacked all at once."""

from __future__ import annotations

import numpy as np

#: Values per word, and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 4096


SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.int8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.max() < 1 << 16:
        return SHORT[values]
    out = np.zeros(len(values), np.int8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = values >= np.uint64(1) << np.uint64(shift)
        out[big] += shift
        values = np.where(big, values >> np.uint64(shift), values)
    return out + (values > 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, first word of each block of BLOCK values)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    lanes = np.arange(-(-n // BLOCK))
    wide = BLOCK + int(COUNTS[0])  # zeros after each block: whatever is left of it fits
    padded = np.zeros((len(lanes), wide), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    padded[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    padded = padded.ravel()
    # For each place the selector with the most values that all fit: the most bits among the next 1, 2, 3, ... values grow step by step.
    most, span = _bit_lengths(padded), 1
    selector = np.full(len(padded), ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        by = int(COUNTS[s]) - span
        if by:
            most = np.maximum(most, np.append(most[by:], np.zeros(by, np.int8)))
            span += by
        selector[most <= BITS[s]] = s
    ahead = np.append(COUNTS, [1, 1])
    place_in, left = np.zeros(len(lanes), np.int64), np.minimum(n - lanes * BLOCK, BLOCK)
    taken = []
    while len(lanes):  # one word of each block at a time
        at = lanes * wide + place_in
        taken.append(at)
        k = ahead[selector[at]]
        place_in, left = place_in + k, left - k
        on = left > 0
        lanes, place_in, left = lanes[on], place_in[on], left[on]
    taken = np.sort(np.concatenate(taken))
    chosen = selector[taken].astype(np.int64)
    raw = chosen == ESCAPE
    size = 1 + raw
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(chosen == s)
        word, at = np.full(len(mine), s, np.uint64), taken[mine]
        for k in range(COUNTS[s] if len(mine) else 0):
            word |= padded[at + k] << np.uint64(4 + k * BITS[s])
        words[place[mine]] = word
    words[place[raw]] = ESCAPE
    words[place[raw] + 1] = padded[taken[raw]]
    return words, place[np.searchsorted(taken, np.arange(-(-n // BLOCK)) * wide)].astype(np.uint32)


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n values; blocks are found by `starts` and unpacked together."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    chosen = (words & np.uint64(15)).astype(np.int64)
    head = np.ones(len(words), bool)
    maybe = np.flatnonzero(chosen == ESCAPE)
    for i in maybe.tolist():  # a raw value may look like an escape: only heads count
        if head[i] and i + 1 < len(words):
            head[i + 1] = False
    at = np.flatnonzero(head)
    chosen = chosen[at]
    count = np.append(COUNTS, [0, 1])[chosen]
    block = np.searchsorted(starts, at, "right") - 1
    total = np.cumsum(count) - count
    first = total - total[np.searchsorted(at, starts)][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s]):
            use = mine[first[mine] + k < stop[mine]]
            out[first[use] + k] = words[at[use]] >> np.uint64(4 + k * BITS[s]) & np.uint64((1 << int(BITS[s])) - 1)
    raw = chosen == ESCAPE
    out[first[raw]] = words[at[raw] + 1]
    return out
