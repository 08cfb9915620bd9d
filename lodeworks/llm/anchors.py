"""Winnowed anchors of byte strings: places that equal 50-byte strings select alike."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes handled at once; a longer document is cut into overlapping stretches.
STRETCH = 1 << 20
ORDER_BITS = 40


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, INVERSE)]))


POWERS = Powers()


def mix(x: np.ndarray, multiplier: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(multiplier)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a] = the sum of (data[i] + 1) * BASE ** i for a <= i < b."""
    POWERS.need(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the bytes from a to b, wherever they lie."""
    return (sums[b] - sums[a]) * POWERS.down[a]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width] for each i."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions selected in the texts data[starts[i] : starts[i + 1]], their gram's hash, the prefix sums.

    Of every string of `length` bytes within a text, the gram with the smallest hash is selected,
    the leftmost on ties.  data may hold at most STRETCH bytes more than a text needs at once.
    """
    sums = prefix_sums(data)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    grams = (sums[gram:] - sums[:-gram]) * POWERS.down[: len(data) - gram + 1]
    order = (mix(grams, 0xBF58476D1CE4E5B9) & ~np.uint64((1 << (64 - ORDER_BITS)) - 1)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(order, length - gram + 1) & np.uint64((1 << (64 - ORDER_BITS)) - 1)).astype(np.int64)
    inside = np.ones(len(data) + 1, bool)  # strings that start here end in the same text
    for k in starts[1:].tolist():
        inside[max(0, k - length + 1) : k] = False
    chosen = chosen[inside[:n]]
    at = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
    return at, mix(grams[at], 0x94D049BB133111EB), sums
