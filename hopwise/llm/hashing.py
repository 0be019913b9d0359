"""Hashes of many byte ranges at once, from running sums of a polynomial over the bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def blank_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _BLANK[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_LETTER = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse, kept by the worker."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 12, 2 * len(_powers[0]))
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(m - 1, b, _U)], dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def running(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' terms, from none to all."""
    return np.r_[_U(0), np.cumsum(_LETTER[data] * powers(len(data))[0][: len(data)], dtype=_U)]


def of_ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What equal byte ranges have in common, before it is mixed."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the words being separated by ASCII white space."""
    if not len(data):
        return np.zeros(0, _U)
    blank = blank_bytes(data)
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    return mixed(of_ranges(running(data), start, end) + (end - start).astype(_U))
