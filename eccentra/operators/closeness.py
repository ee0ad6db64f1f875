"""Close positions of many images at a time, as flat arrays sorted by image, x and y.

Positions are distinct whole pixels, so an image of one tile (1,024 pixels) has a bound. ``own`` is the number of a position's image.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Candidates looked at in one step; candidates a position of an image that is gone through one by one.
STEP, DENSE = 1 << 20, 24


class Strips:
    """Columns as wide as ``d``, sorted by y: what may be close to a position lies in a run of its strip and in one of the next."""

    def __init__(self, own: np.ndarray, x: np.ndarray, y: np.ndarray, d: float):
        self.d, n = d, len(x)
        reach = int(d)
        strip, down = (x - x.min(initial=0)) // max(1, reach), y - y.min(initial=0) + reach
        tall = int(down.max(initial=0)) + reach + 1
        code = (own * (int(strip.max(initial=0)) + 2) + strip) * tall + down
        self.order = np.argsort(code, kind="stable")
        self.x, self.y, held = x[self.order], y[self.order], code[self.order]
        runs = [(np.arange(1, n + 1), np.searchsorted(held, held + reach, side="right")),
                (np.searchsorted(held, held + tall - reach), np.searchsorted(held, held + tall + reach, side="right"))]
        self.runs = [(lo, np.maximum(hi - lo, 0)) for lo, hi in runs]

    def candidates(self) -> np.ndarray:
        out = np.zeros(len(self.x), np.int64)
        out[self.order] = sum(n for _, n in self.runs)
        return out

    def pairs(self, some: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lots of pairs (a before b) at most ``d`` apart, of positions in ``some``."""
        for lo, n in self.runs:
            if some is not None:
                n = np.where(some[self.order], n, 0)
            total = np.cumsum(n)
            at = 0
            while at < len(n):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
                a = np.repeat(np.arange(at, end), n[at:end])
                first = total[at:end] - n[at:end] - (total[at - 1] if at else 0)
                b = np.arange(len(a)) - np.repeat(first - lo[at:end], n[at:end])
                near = (self.x[a] - self.x[b]) ** 2 + (self.y[a] - self.y[b]) ** 2 <= self.d * self.d
                a, b = self.order[a[near]], self.order[b[near]]
                yield np.minimum(a, b), np.maximum(a, b)
                at = end


def components(own: np.ndarray, x: np.ndarray, y: np.ndarray, d: float) -> np.ndarray:
    """First position of everyone's component of steps of at most ``d``."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    root = np.arange(len(x))
    for a, b in Strips(own, x, y, d).pairs():
        while True:
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _walk(x: np.ndarray, y: np.ndarray, order: np.ndarray, d: float) -> np.ndarray:
    label = np.full(len(x), -1)
    left, right = np.searchsorted(x, x - d), np.searchsorted(x, x + d, side="right")
    for i in order:
        if label[i] == -1:
            lo, hi = left[i], right[i]
            label[lo:hi][(x[lo:hi] - x[i]) ** 2 + (y[lo:hi] - y[i]) ** 2 <= d * d] = i
    return label


def taken(own: np.ndarray, x: np.ndarray, y: np.ndarray, d: float, order: np.ndarray) -> np.ndarray:
    """Label of every position if they are gone through in ``order`` and each still unlabelled one labels all within ``d``.

    Where few are close, all that no undecided or taking one precedes take at once, round by round; the last one to take gives the
    label. Dense images are gone through one by one, as few of their positions take.
    """
    x, y = x.astype(np.int64), y.astype(np.int64)
    n = len(x)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    strips = Strips(own, x, y, d)
    size = np.bincount(own)
    dense = np.bincount(own, strips.candidates()) > DENSE * size
    label, thin = np.arange(n), ~dense[own]
    lots = list(strips.pairs(thin))
    a, b = (np.concatenate([lot[i] for lot in lots] or [np.zeros(0, np.int64)]) for i in (0, 1))
    swap = rank[a] > rank[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    open_, takes, u, v = thin.copy(), np.zeros(n, bool), a, b
    while True:
        second = np.zeros(n, bool)
        second[v] = True
        now = open_ & ~second
        takes |= now
        open_ &= second
        if not len(u):
            break
        open_[v[now[u]]] = False
        live = open_[u] & open_[v]
        u, v = u[live], v[live]
    best = np.where(takes, rank, -1)
    np.maximum.at(best, b[takes[a]], rank[a[takes[a]]])
    np.maximum.at(best, a[takes[b]], rank[b[takes[b]]])
    label[thin] = order[best[thin]]
    ends = np.cumsum(size)
    for i in np.flatnonzero(dense):
        lo, hi = ends[i] - size[i], ends[i]
        label[lo:hi] = lo + _walk(x[lo:hi], y[lo:hi], np.argsort(rank[lo:hi]), d)
    return label
