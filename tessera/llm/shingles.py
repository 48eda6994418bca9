"""Hashed word-shingle sets of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import flat_bytes

_U = np.uint64
# An odd base modulo 2 ** 64 and odd multipliers for the words of a shingle.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)

_up = _down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    global _up, _down
    if len(_up) < n:
        n = max(n, 1 << 20)
        _up, _down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, _INVERSE))
    return _up, _down


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> _U(27))) * _U(0x94D049BB133111EB)
    return v ^ (v >> _U(31))


class Words:
    """The words of a batch of texts: runs of bytes where ``inside``, which end with their text.

    starts, stops: their places; first: the number of each text's first word, and one more.
    """

    def __init__(self, low: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(low)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        outside = ~inside
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= outside[:-1] | edge[1:n]
        ends[:-1] &= outside[1:] | edge[1:n]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, self._down = powers(n + 1)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + _U(1)) * up[:n], out=self._prefix[1:])

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self._prefix[stops] - self._prefix[starts]) * self._down[starts] + (stops - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: empty).

    Words are runs of bytes other than space and the controls 9 to 13, after lower-casing A-Z. A text of fewer than k
    words but one at least has its whole sequence as its one shingle.
    """
    flat, offsets = flat_bytes(texts)
    low = flat + ((flat >= 65) & (flat <= 90)) * np.uint8(32)
    found = Words(low, offsets, ~((flat == 32) | ((flat >= 9) & (flat <= 13))))
    words, first = found.hashes(found.starts, found.stops), found.first
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams = mix(grams * _U(0x2545F4914F6CDD1D) + words[j : j + len(grams)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mix(whole * _U(0x2545F4914F6CDD1D) + w + _U(7))
            yield whole
        else:
            yield np.zeros(0, np.uint64)
