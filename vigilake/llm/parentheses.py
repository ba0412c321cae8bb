"""A tree as balanced parentheses, with a tree of excess minima over blocks that finds closing ones.

Bit 1 opens a node and 0 closes it, in preorder.  The excess after a bit is the number of open nodes.  The node opened at
p closes at the first place behind p whose excess is lower; blocks of ``BLOCK`` bits and a binary tree over their minima
lead there in logarithmic time, for all nodes at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """``bits`` is balanced: every prefix has at least as many ones as zeros, the whole as many."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.excess = np.cumsum(np.where(self.bits, 1, -1), dtype=np.int32)
        blocks = max(1, -(-len(bits) // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self.leaves * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:len(bits)] = self.excess
        self.padded = padded
        self.least = np.empty(2 * self.leaves, np.int32)
        self.least[self.leaves:] = padded.reshape(-1, BLOCK).min(axis=1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            lo = 1 << level
            self.least[lo:2 * lo] = np.minimum(self.least[2 * lo:4 * lo:2], self.least[2 * lo + 1:4 * lo:2])
        pairs = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            pairs[1:-1] = np.cumsum(self.bits[:-1] & ~self.bits[1:])
            pairs[-1] = pairs[-2]
        #: number of pairs "()" that open before each place
        self.pairs = pairs

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where each of the nodes closes."""
        below = self.excess[opens]
        out = np.full(len(opens), -1, np.int64)
        left = self._scan(np.arange(len(opens)), opens + 1, (opens // BLOCK + 1) * BLOCK, below, out)
        # up: to the nearest block on the right whose least excess is low enough, or a node of the tree above it
        at, found = opens // BLOCK + self.leaves, np.zeros(len(opens), np.int64)
        going = left
        while len(going):
            here = at[going]
            hit = ((here & 1) == 0) & (self.least[here | 1] < below[going])
            found[going[hit]] = here[hit] | 1
            at[going] = here >> 1
            going = going[~hit]
        # down: to the first such block
        going = left[found[left] < self.leaves]
        while len(going):
            child = 2 * found[going]
            found[going] = np.where(self.least[child] < below[going], child, child + 1)
            going = going[found[going] < self.leaves]
        block = (found[left] - self.leaves) * BLOCK
        self._scan(left, block, block + BLOCK, below, out)
        return out

    def _scan(self, which: np.ndarray, start: np.ndarray, end: np.ndarray, below: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Looks at the bits from ``start`` up to ``end``, both of each of ``which``; returns those without a result."""
        place, done = start.copy(), np.zeros(len(which), bool)
        active = np.flatnonzero(place < end)
        while len(active):
            hit = self.padded[place[active]] < below[which[active]]
            out[which[active[hit]]] = place[active[hit]]
            done[active[hit]] = True
            active = active[~hit]
            place[active] += 1
            active = active[place[active] < end[active]]
        return which[~done]
