"""Vectorised hashes of words, word runs and byte strings in a buffer of texts.

A string's hash is a polynomial in an odd base over random 64-bit values of
its symbols, modulo 2^64, finished by a bijective mix. Prefix sums give the
hash of every substring, and powers of the base's inverse make it independent
of where the string stands. Two families with their own bases and values make
128-bit names, which stand for equality.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def _family(number: int) -> tuple[int, int, np.ndarray]:
    """Base, its inverse modulo 2^64, and the values of the 256 bytes."""
    random = np.random.default_rng(1000 + number)
    base = int(random.integers(1 << 62, 1 << 63)) * 2 + 1
    return base, pow(base, -1, 1 << 64), random.integers(0, 1 << 64, 256, np.uint64, False)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(number: int, inverse: bool, n: int) -> np.ndarray:
    kept = _POWERS.get((number, inverse))
    if kept is None or len(kept) < n:
        base = _family(number)[1 if inverse else 0]
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        kept = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _POWERS[number, inverse] = kept
    return kept[:n]


def _sums(values: np.ndarray, number: int) -> np.ndarray:
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _powers(number, False, len(values)), out=sums[1:])
    return sums


class Bytes:
    """Hashes of the substrings of a buffer."""

    def __init__(self, data: np.ndarray, number: int) -> None:
        self.number, self.sums = number, _sums(_family(number)[2][data], number)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        powers = _powers(self.number, True, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * powers[starts])


class Words:
    """The words of a buffer of texts (divided by ASCII white space) and hashes of runs of them.

    ``start`` and ``end`` bound each word in the buffer; ``first`` has, for
    each text, the number of its first word, and one entry more.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        """``ends``: n + 1 offsets into ``data``, from 0 to its length."""
        self.data = data
        solid = ~_SPACES[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = True, True
            before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, ends, "left")
        self._sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, at: np.ndarray, length: int | np.ndarray, number: int = 0) -> np.ndarray:
        """Hashes of ``length`` words from each word in ``at`` on."""
        if number not in self._sums:
            self._sums[number] = _sums(Bytes(self.data, number).of(self.start, self.end), number)
        sums = self._sums[number]
        return mix((sums[at + length] - sums[at]) * _powers(number, True, len(sums))[at] + np.uint64(number))
