"""Nearest entries by a GNAT (geometric near-neighbour access tree).

A node picks split points spread out among its entries; every other entry
goes to the child of its nearest split point.  For each split point and each
child the node stores the smallest and largest distance from the point to the
entries of the child (its own split point included).  A query that lies at
distance d from a split point and knows an entry at distance r needs only
children whose range meets [d - r, d + r]; all others go with their subtree.

Squared distances are whole numbers and decide every comparison of entries;
only the ranges use roots.  Roots, and the sums made of them, are rounded
outward by one step, and a subtree goes only if it is strictly out of reach,
so an entry at exactly the best distance is always seen and ties go to the
lower index.

Many queries walk the tree together, as rows of one array.
"""

from __future__ import annotations

import numpy as np

DEGREE = 8
LEAF = 6


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def _down(x):
    return np.nextafter(x, -np.inf)


def _up(x):
    return np.nextafter(x, np.inf)


def _split_points(entries: np.ndarray, members: np.ndarray, degree: int) -> list[int]:
    """``degree`` places in ``members``, each the farthest from those before
    it; fewer if the entries have fewer distinct values."""
    chosen = [0]
    gap = squared(entries[members], entries[members[0]])
    while len(chosen) < degree:
        far = int(np.argmax(gap))
        if gap[far] == 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, squared(entries[members], entries[members[far]]))
    return chosen


class Gnat:
    """The tree over whole-number ``entries`` (one a row)."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        self.degree, self.leaf = degree, leaf
        self.root = self._build(np.arange(len(self.entries)))
        #: Distances computed and the number that a scan would take.
        self.computed = self.scanned = 0

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        places = _split_points(self.entries, members, self.degree)
        if len(places) == 1:  # equal entries: the lowest index stands for all
            return members[:1]
        points = members[places]
        gaps = np.stack([squared(self.entries[members], self.entries[p]) for p in points], axis=1)
        owner = gaps.argmin(axis=1)
        owner[places] = np.arange(len(places))
        low, high = np.empty((len(points),) * 2), np.empty((len(points),) * 2)
        children = []
        for j in range(len(points)):
            own = owner == j
            roots = np.sqrt(gaps[own].astype(np.float64))
            low[:, j], high[:, j] = _down(roots.min(axis=0)), _up(roots.max(axis=0))
            rest = own.copy()
            rest[places[j]] = False
            children.append(self._build(members[rest]) if rest.any() else None)
        return points, low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, ties to the
        lower index."""
        queries = np.ascontiguousarray(queries, dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries), dtype=np.int64)
        self.scanned += len(queries) * len(self.entries)
        self._search(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _meet(self, queries, rows, entry: int, best, index) -> np.ndarray:
        gap = squared(queries[rows], self.entries[entry])
        self.computed += len(rows)
        wins = (gap < best[rows]) | ((gap == best[rows]) & (entry < index[rows]))
        best[rows[wins]], index[rows[wins]] = gap[wins], entry
        return gap

    def _search(self, node, queries, rows, best, index) -> None:
        if not isinstance(node, tuple):
            for entry in node:
                self._meet(queries, rows, int(entry), best, index)
            return
        points, low, high, children = node
        alive = np.ones((len(rows), len(points)), dtype=bool)
        near = np.full((len(rows), len(points)), np.iinfo(np.int64).max)
        for i, point in enumerate(points):
            asked = np.flatnonzero(alive[:, i])
            if not len(asked):
                continue
            gap = self._meet(queries, rows[asked], int(point), best, index)
            near[asked, i] = gap
            root = np.sqrt(gap.astype(np.float64))[:, None]
            reach = _up(np.sqrt(best[rows[asked]].astype(np.float64)))[:, None]
            beyond = _down(_down(root) - reach) > high[i]
            before = _up(_up(root) + reach) < low[i]
            alive[asked] &= ~(beyond | before)
        # Children of near split points first: they lower the reach of the rest.
        order = np.argsort(near, axis=1, kind="stable")
        for turn in range(len(points)):
            for j, child in enumerate(children):
                if child is None:
                    continue
                at = np.flatnonzero((order[:, turn] == j) & alive[:, j])
                if not len(at):
                    continue
                # The best may have come nearer since: look at the ranges again.
                reach = _up(np.sqrt(best[rows[at]].astype(np.float64)))
                known = near[at] < np.iinfo(np.int64).max
                root = np.sqrt(near[at].astype(np.float64))
                gone = (_down(_down(root) - reach[:, None]) > high[:, j]) | (_up(_up(root) + reach[:, None]) < low[:, j])
                at = at[~(gone & known).any(axis=1)]
                if len(at):
                    self._search(child, queries, rows[at], best, index)
