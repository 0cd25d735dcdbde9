"""An R-tree over count vectors.

A set of hashed tokens is a point: how many of its tokens fall into each of ``DIMENSIONS`` groups. Two sets share at most the sum
over the groups of the smaller count, and a set shares at most that with anything in a box whose upper corner takes the place
of the other point. Whatever cannot reach the overlap that the similarity asks for is left out without being looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIMENSIONS = 64
FAN_OUT = 16


def point(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)


def needed(a, b, percent: int):
    """Least overlap of sets of a and b tokens whose Jaccard similarity is at least percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def bound(upper: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Summed coordinate minima: no set below ``upper`` (a row or many) shares more tokens with ``p``."""
    return np.minimum(upper, p).sum(axis=-1)


class CountTree:
    """Bulk-loaded: points in the order of their coarse coordinates, FAN_OUT to a box, boxes to boxes, up to one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        coarse = points.reshape(len(points), 8, -1).sum(axis=2)
        self.order = np.lexsort((*coarse.T[::-1], sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            upper, least = self.levels[-1]
            cuts = np.arange(0, len(upper), FAN_OUT)
            self.levels.append((np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(least, cuts)))

    def near(self, p: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of all points that may be that similar to ``p``, ascending."""
        rows = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            rows = rows[bound(upper[rows], p) >= needed(least[rows], size, percent)]
            if depth:
                rows = (rows[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                rows = rows[rows < len(self.levels[depth - 1][0])]
        return np.sort(self.order[rows])


class Union:
    """Disjoint groups of numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def links(left: list[tuple], right: list[tuple] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links (a, b) between members of ``left`` and ``right`` (of ``left`` alone if right is None) that join groups not joined
    before: enough to connect all that are similar. A member is (number, group, sorted hashes, point)."""
    union = Union()
    for number, group, *_ in [*left, *(right or [])]:
        union.join(number, group)
    tree = CountTree(np.array([m[3] for m in left]), np.array([len(m[2]) for m in left]))
    for k, (number, _, hashes, p) in enumerate(left if right is None else right):
        for i in tree.near(p, len(hashes), percent):
            if right is None and i >= k:
                break
            other = left[i]
            if union.root(other[0]) == union.root(number):
                continue
            if similar(other[2], hashes, percent):
                union.join(other[0], number)
                yield min(other[0], number), max(other[0], number)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)
