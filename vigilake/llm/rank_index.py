"""A learned index from rank to offset: straight pieces with bounded error, exact by stored residuals.

The offsets are an increasing sequence (where the tokens of many texts begin).  A piece begins at a rank and has a
slope; it is made longer as long as one slope keeps all its predictions within ``ERROR`` of the truth (the cone of
slopes that allow it shrinks with every point).  What the prediction misses is stored, a byte for each rank, so a lookup
is the search of a piece, a multiplication and one addition, and its result is exact.
"""

from __future__ import annotations

import numpy as np

ERROR = 120
#: points that are looked at together while a piece grows
BLOCK = 2048


class RankIndex:
    """Offsets by rank.  ``starts``: rank at which each piece begins; ``base`` and ``slope``: its line."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        self.size = len(offsets)
        starts, slopes = [], []
        at = 0
        while at < self.size:
            end, slope = _piece(offsets, at, error)
            starts.append(at)
            slopes.append(slope)
            at = end
        self.starts = np.array(starts, np.int64)
        self.slope = np.array(slopes, np.float64)
        self.base = offsets[self.starts].astype(np.int64) if starts else np.zeros(0, np.int64)
        self.residual = np.zeros(self.size, np.int8)
        for lo in range(0, self.size, 1 << 20):
            ranks = np.arange(lo, min(lo + (1 << 20), self.size))
            self.residual[lo:lo + len(ranks)] = offsets[ranks] - self.predict(ranks)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.starts, ranks, "right") - 1
        return self.base[piece] + np.floor((ranks - self.starts[piece]) * self.slope[piece]).astype(np.int64)

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def _piece(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """(rank behind the longest piece that begins at ``at``, its slope)."""
    low, high = 0.0, np.inf
    lo = at + 1
    while lo < len(offsets):
        run = np.arange(lo, min(lo + BLOCK, len(offsets)))
        rise = (offsets[run] - offsets[at]).astype(np.float64)
        lows = np.maximum.accumulate(np.maximum((rise - error) / (run - at), low))
        highs = np.minimum.accumulate(np.minimum((rise + error) / (run - at), high))
        outside = np.flatnonzero(lows > highs)
        if len(outside):
            stop = int(outside[0])
            if stop:
                low, high = lows[stop - 1], highs[stop - 1]
            return lo + stop, _between(low, high)
        low, high = lows[-1], highs[-1]
        lo += len(run)
    return max(lo, at + 1), _between(low, high)


def _between(low: float, high: float) -> float:
    return low if high == np.inf else (low + high) / 2
