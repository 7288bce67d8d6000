"""A ball tree for inner products: which rows of a block exceed a bound in some direction, by looking at few of them.

Rows are halved along their widest column until LEAF are left; each node has a centre and a radius, so no row below it exceeds
centre.w + radius * |w|, and its columns' ends, which often bound closer. A search goes down level by level with all directions at once and leaves out nodes whose bound is too small.
"""

from __future__ import annotations

import numpy as np

LEAF = 32


class Tree:
    """Over the rows of z, reordered: `order` has their numbers. ordered: they are in such an order already."""

    def __init__(self, z: np.ndarray, ordered: bool = False):
        n = len(z)
        self.order, splits = np.arange(n), [np.array([0, n])]
        for _ in range(max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))):
            for a, b in zip(splits[-1][:-1], splits[-1][1:], strict=True) if not ordered else ():
                rows = z[self.order[a:b]]
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, np.argmax(np.ptp(rows, axis=0))], (b - a) // 2)]
            splits.append(np.sort(np.concatenate([splits[-1], (splits[-1][:-1] + splits[-1][1:]) // 2])))
        self.z = z[self.order]
        #: First and last row, centre, radius and columns' half lengths of each level's nodes.
        self.levels = [self._level(at) for at in splits] if n else []

    def _level(self, at: np.ndarray):
        sizes = np.diff(at)
        centre = np.add.reduceat(self.z, at[:-1], axis=0) / sizes[:, None]
        far = np.sqrt(((self.z - np.repeat(centre, sizes, axis=0)) ** 2).sum(1))
        half = np.maximum.reduceat(np.abs(self.z - np.repeat(centre, sizes, axis=0)), at[:-1])
        return at[:-1], at[1:], centre, np.maximum.reduceat(far, at[:-1]) * (1 + 1e-9) + 1e-12, half * (1 + 1e-9) + 1e-12

    def _bound(self, level: int, node: np.ndarray, w: np.ndarray, norm: np.ndarray) -> np.ndarray:
        _, _, centre, radius, half = self.levels[level]
        return (centre[node] * w).sum(1) + np.minimum(radius[node] * norm, (half[node] * np.abs(w)).sum(1))

    def search(self, w: np.ndarray, least: np.ndarray, looked: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(direction, row of the reordered z, z.w) of all rows with z.w > least, for each direction (row of w) with its least."""
        if not self.levels or not len(w):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        norm = np.sqrt((w**2).sum(1))
        q, starts = np.arange(len(w)), np.zeros(len(w), int)
        for level, (first, last, *_) in enumerate(self.levels):
            if level:  # a node's halves start at its own start and at its middle
                above = self.levels[level - 1]
                up = np.searchsorted(above[0], starts)
                q, starts = np.tile(q, 2), np.concatenate([starts, (above[0][up] + above[1][up]) // 2])
            node = np.searchsorted(first, starts)
            keep = self._bound(level, node, w[q], norm[q]) > least[q]
            q, starts, node = q[keep], starts[keep], node[keep]
        sizes = last[node] - first[node]
        rows = np.repeat(first[node] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(node) else np.zeros(0, int)
        q = np.repeat(q, sizes)
        if looked is not None:
            looked.append(len(rows))
        value = (self.z[rows] * w[q]).sum(1)
        found = value > least[q]
        return q[found], rows[found], value[found]

    def near(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the leaf that the larger bounds lead to, for each direction, and their z.w: a matrix each, with -inf where a leaf
        has fewer rows. A quick look for rows with a large z.w, not a sure one."""
        if not self.levels:
            return np.zeros((len(w), 0), int), np.zeros((len(w), 0))
        norm, starts = np.sqrt((w**2).sum(1)), np.zeros(len(w), int)
        for level in range(1, len(self.levels)):
            first, above = self.levels[level][0], self.levels[level - 1]
            up = np.searchsorted(above[0], starts)
            middle = (above[0][up] + above[1][up]) // 2
            right = self._bound(level, np.searchsorted(first, middle), w, norm) > self._bound(level, np.searchsorted(first, starts), w, norm)
            starts = np.where(right, middle, starts)
        first, last, *_ = self.levels[-1]
        node = np.searchsorted(first, starts)
        rows = first[node][:, None] + np.arange((last - first).max())
        inside = rows < last[node][:, None]
        rows = np.minimum(rows, len(self.z) - 1)
        return rows, np.where(inside, np.einsum("qkd,qd->qk", self.z[rows], w), -np.inf)
