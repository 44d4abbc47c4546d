"""Bin packing: best-fit decreasing with a segment tree over capacities, and lower bounds.

All capacities and lengths are integers in 1..capacity.
"""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Segment tree over residual capacities 0..capacity.

    A leaf holds the open bins with exactly that residual; an inner node knows how many
    bins lie below it.  ``take`` finds the smallest residual that still fits a length in
    O(log capacity).
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, residual: int, bin_id: int) -> None:
        self.bins[residual].append(bin_id)
        at = residual + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (bin, residual) of the best fit, or None."""
        count, at = self.count, length + self.size
        if not count[at]:
            while True:  # climb until a right sibling holds a bin
                if at == 1:
                    return None
                if not at & 1 and count[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.size:
                at <<= 1
                if not count[at]:
                    at += 1
        residual = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.bins[residual].pop(), residual


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.

    Longest first; each item goes to the fullest bin that still holds it.  Equal lengths
    keep their order.  An empty input gives no bins.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = tree.take(length)
        if found is None:
            found = (opened, capacity)
            opened += 1
        bin_id, residual = found
        bins[i], offsets[i] = bin_id, capacity - residual
        if residual > length:
            tree.put(residual - length, bin_id)
    fill = np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64) if opened else np.zeros(0, np.int64)
    return bins, offsets, fill


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing needs, by dual feasible functions.

    A dual feasible function f maps lengths so that whatever fits a bin before still fits
    after; ceil(sum f / capacity) is then a bound.  Used here: the identity, the threshold
    family (items over capacity - e count whole, items under e count nothing) for every
    length e that occurs, and the rounding family f_k(x) = floor((k+1)x) / k for k to 64.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = count * size
    best = -(-int(total.sum()) // capacity)
    above, sums = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(total)])
    for e in {*np.flatnonzero(count[: capacity // 2 + 1]).tolist(), capacity // 2} - {0}:
        whole, middle = int(above[capacity - e + 1]), int(sums[capacity - e + 1] - sums[e])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * size
        # in units of 1/k of a bin, times capacity, to stay in integers
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best
