"""Column-wise construction of the Burrows-Wheeler transform of a collection.

Round j inserts the suffixes of length j, one symbol of every text that is
long enough. The transform lists, in the order of all suffixes inserted so
far, the symbol before each; writing the round's symbols to the places of the
last round's suffixes and sorting the list stably by symbol gives the new
suffixes' places. Common prefixes are carried along: behind the same symbol
they are one longer than the least between the two places in the old order.

Every round is a few sequential passes over the old lists that write the new
ones: the sort is a counting sort of symbols of 16 bits, and the least common
prefix of a range comes from the least ones of runs of 1, 2, 4 and more. Which
suffix stands where is not listed; walking the finished transform tells it,
one symbol of every text a step.

The lists of one collection are kept in memory, as callers bound its size.
"""

from __future__ import annotations

import numpy as np


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The least value from ``first`` to ``last``, both included, of each pair; ``space`` is room for ``len(values)`` times its binary logarithm."""
    if not len(first):
        return values[:0]
    depth = np.frexp((last - first + 1).astype(np.float64))[1] - 1  # two runs of 2 ** depth cover the pair's range
    n, span = len(values), 1
    levels = int(depth.max()) + 1
    runs = space[: levels * n].reshape(levels, n)
    runs[0] = values
    for level in range(1, levels):
        runs[level, n - span :] = runs[level - 1, n - span :]
        np.minimum(runs[level - 1, : n - span], runs[level - 1, span:], out=runs[level, : n - span])
        span *= 2
    runs, at = runs.reshape(-1), depth * n
    return np.minimum(runs[at + first], runs[at + last + 1 - (1 << depth)])


def repeated_starts(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each symbol, whether the ``length`` symbols from it on lie in its text and also start elsewhere in the collection.

    ``data`` has the texts' symbols one text after the other, all above 0 (which is the end of a text).
    """
    m, stops = len(sizes), np.cumsum(sizes)
    before = np.zeros(m, data.dtype)  # the transform
    common = np.zeros(m, np.int16)  # common prefix with the suffix before
    space = np.empty((len(data) + m) * (len(data) + m).bit_length(), common.dtype)
    live, place = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        more = sizes[live] >= j
        live, place = live[more], place[more]
        before[place] = data[stops[live] - j]
        n, ended = len(before), m - len(live)
        order = np.argsort(before, kind="stable")
        last = np.zeros(n, bool)
        last[place] = True
        new = np.flatnonzero(last[order])
        live = live[np.searchsorted(place, order[new])]

        # Common prefixes of the new suffixes with those before them, and of those behind with them.
        near = np.zeros(n + 1, bool)
        near[new] = near[new + 1] = True
        near = np.flatnonzero(near[:n])
        touched = near[near > ended]
        left, right = order[touched - 1], order[touched]
        same = before[left] == before[right]
        touched = touched[same]
        longest = np.minimum(_least(common, left[same] + 1, right[same], space) + 1, length)

        place = new + len(live)
        old = np.ones(n + len(place), bool)
        old[place] = False
        grown = np.zeros(len(old), before.dtype)
        grown[old] = before
        prefixes = np.empty(len(old), common.dtype)
        prefixes[old] = common
        prefixes[near + len(live)] = 0
        prefixes[touched + len(live)] = longest
        before, common = grown, prefixes

    alike = common >= length
    alike[:-1] |= common[1:] >= length
    step = np.empty(len(before), np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(len(before))
    found = np.zeros(len(data), bool)
    live, place = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        more = sizes[live] >= j
        live = live[more]
        place = step[place[more]]
        found[stops[live] - j] = alike[place]
    return found
