"""Words of whole batches of texts, hashed in numpy."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd base of the word hash and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SECOND = np.uint64(0xD1342543DE82EF95)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (run of bytes other than ASCII white space), and its text's number."""
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = ~_BLANK[data]
    begin = full[1:] & ~full[:-1]
    cut = bounds[1:-1]
    begin[cut] |= full[cut + 1]
    first = np.flatnonzero(begin)
    ends = ~full[1:] & full[:-1]
    ends[cut] |= full[cut]
    last = np.flatnonzero(ends)
    return first, last, np.searchsorted(bounds, first, side="right") - 1


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch: a polynomial of its bytes and length, finalised."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up = powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    down = powers(_INVERSE, len(data))
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _SECOND)


def windows(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every ``n`` words in a row of one text; a window stands at its first word."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(m, np.uint64)
    for k in range(n):
        value = value * np.uint64(_BASE) + word[k:k + m]
    inside = text[:m] == text[n - 1:]
    return mixed(value), np.where(inside, text[:m], -1)
