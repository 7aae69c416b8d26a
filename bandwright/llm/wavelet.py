"""A wavelet tree over the points (x, y) of a permutation, for reporting all points in rectangles. All queries go down the levels together."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """values: y for each x, each from 0 to len(values) - 1 once. A level holds one bit of y, highest first, its values parted stably by the bits before."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.ones: list[np.ndarray] = []
        self.depth = max(1, int(self.size - 1).bit_length()) if self.size else 0
        for level in reversed(range(self.depth)):
            bits = values >> level & 1
            before = np.zeros(self.size + 1, np.int32)  # ones up to each place
            np.cumsum(bits, out=before[1:])
            self.ones.append(before)
            values = np.concatenate((values[bits == 0], values[bits == 1]))

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, y) of every point with x0 <= x < x1 and y0 <= y < y1."""
        query = np.flatnonzero((x0 < x1) & (y0 < y1))
        left, right, base = x0[query], x1[query], np.zeros(len(query), np.int64)
        low, high = y0[query], y1[query]
        for k, before in enumerate(self.ones):
            span = 1 << self.depth - 1 - k
            ones_left, ones_right = before[left], before[right]
            zeros = self.size - before[-1]
            sides = []
            for one in (False, True):
                a, b = (zeros + ones_left, zeros + ones_right) if one else (left - ones_left, right - ones_right)
                first = base + span if one else base
                live = (a < b) & (first < high) & (first + span > low)
                sides.append((query[live], a[live], b[live], first[live], low[live], high[live]))
            query, left, right, base, low, high = (np.concatenate(pair) for pair in zip(*sides, strict=True))
        return query, base
