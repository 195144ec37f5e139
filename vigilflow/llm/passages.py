"""Where known passages may lie in texts: positions whose shingle occurs in any passage.

A necessary condition, not a result: a window that shares too few shingles with all passages together can't
reach the asked similarity with one of them, so only the others are fingerprinted and looked up.
"""

from __future__ import annotations

import numpy as np


class KnownShingles:
    """A set of shingle hashes: a bit table answers most lookups, a sorted array the rest."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = min(26, max(16, int(np.ceil(np.log2(max(len(self.sorted), 1) * 16)))))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.sorted >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of hashes are in the set."""
        out = self.table[(hashes >> self.shift).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            if len(self.sorted) == 0:
                out[at] = False
            else:
                place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
                out[at] = self.sorted[place] == hashes[at]
        return out


def windows(hit: np.ndarray, length: int, least: int, stride: int = 1) -> np.ndarray:
    """Starts, each a multiple of stride or the last possible, of windows of length with least hits or more."""
    n = len(hit)
    length = min(length, n)
    total = np.concatenate(([0], np.cumsum(hit)))
    starts = np.arange(0, n - length + 1, stride)
    if stride > 1 and (n - length) % stride:
        starts = np.append(starts, n - length)
    return starts[total[starts + length] - total[starts] >= least]
