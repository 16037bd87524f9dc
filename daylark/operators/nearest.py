"""The nearest training rows of rows with gaps, exactly and among all of them.

Training rows come in blocks of a bounded size. In a block those that know the same features stand together, sorted by one
of the features that they share with a row, so that only rows near it in that feature are compared.
"""

from __future__ import annotations

import numpy as np

#: Key of a training row that shares no feature, and of an empty place.
UNRELATED, NONE = 1 << 62, (1 << 63) - 1
#: Rows, and training rows on either side of them, that are compared at a time: the first ones only set a bound.
ROWS_AT_ONCE, FIRST, MOST = 256, 32, 2048


class Found:
    """The ``k`` best (key, ref, value) so far of each row and feature, best first; keys are distances in millionths."""

    def __init__(self, rows: int, width: int, k: int):
        self.keys, self.refs = np.full((rows, width, k), NONE), np.full((rows, width, k), NONE)
        self.values = np.full((rows, width, k), np.nan)

    def add(self, c: int, rows: np.ndarray, keys: np.ndarray, refs: np.ndarray, values: np.ndarray) -> None:
        """Candidates for feature ``c``: row, key, ref and value of each."""
        better = keys <= self.keys[rows, c, -1]
        rows, keys, refs, values = rows[better], keys[better], refs[better], values[better]
        if not len(rows):
            return
        own, k = np.unique(rows), self.keys.shape[2]
        parts = [(np.repeat(own, k), rows), (self.keys[own, c].ravel(), keys), (self.refs[own, c].ravel(), refs), (self.values[own, c].ravel(), values)]
        rows, keys, refs, values = map(np.concatenate, parts)
        order = np.lexsort((refs, keys, rows))
        place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
        kept = order[place < k]  # k of each row, as empty places are among them
        for out, x in ((self.keys, keys), (self.refs, refs), (self.values, values)):
            out[own, c] = x[kept].reshape(len(own), k)


class Block:
    """Training rows with scaled numbers ``z`` (NaN: none), ``values`` to take over (NaN: none) and ``refs``, whose order decides ties."""

    def __init__(self, z: np.ndarray, values: np.ndarray, refs: np.ndarray):
        self.z, self.values, self.refs, self.groups = z, values, refs, []
        self.sorted: dict = {}
        if not z.size:
            return
        traits = np.concatenate([~np.isnan(z), ~np.isnan(values)], axis=1)
        kinds, which = np.unique(traits, axis=0, return_inverse=True)
        order = np.lexsort((refs, which.ravel()))
        groups = np.split(order, np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))[:-1])
        width = z.shape[1]
        # the largest first: they bound the rest
        self.groups = sorted(((kind[:width], kind[width:], rows) for kind, rows in zip(kinds, groups)), key=lambda g: -len(g[2]))

    def _points(self, at: int, shared: tuple[int, ...], k: int) -> tuple[int, np.ndarray]:
        """The feature of ``shared`` with most values, and the rows of a group in its order; of rows with equal shared values the first ``k`` refs."""
        if (at, shared) not in self.sorted:
            rows = self.groups[at][2]
            main = max(shared, key=lambda c: len(np.unique(self.z[rows, c])))
            columns = [self.z[rows, c] for c in (*(c for c in shared if c != main), main)]
            order = np.lexsort((np.arange(len(rows)), *columns))
            apart = np.any([np.diff(x[order], prepend=np.nan) != 0 for x in columns], axis=0)
            starts = np.flatnonzero(apart)
            place = np.arange(len(rows)) - starts[np.cumsum(apart) - 1]
            self.sorted[at, shared] = main, rows[order[place < k]]
        return self.sorted[at, shared]

    def search(self, z: np.ndarray, wanted: np.ndarray, found: Found, unrelated: bool) -> None:
        """Bring in what this block has for the ``wanted`` features of rows ``z``."""
        if not len(z):
            return
        width, k = z.shape[1], found.keys.shape[2]
        kinds, which = np.unique(np.concatenate([~np.isnan(z), wanted], axis=1), axis=0, return_inverse=True)
        for kind, traits in enumerate(kinds):
            mine = np.flatnonzero(which.ravel() == kind)
            for at, (known, has, group) in enumerate(self.groups):
                targets = np.flatnonzero(traits[width:] & has)
                shared = tuple(np.flatnonzero(traits[:width] & known).tolist())
                if not len(targets):
                    continue
                if shared:
                    main, points = self._points(at, shared, k)
                    mine = mine[np.argsort(z[mine, main], kind="stable")]
                    for start in range(0, len(mine), ROWS_AT_ONCE):
                        self._compare(z, mine[start : start + ROWS_AT_ONCE], points, shared, main, targets, found)
                elif unrelated:
                    first = group[:k]
                    rows, others = np.repeat(mine, len(first)), np.tile(first, len(mine))
                    for c in targets:
                        found.add(c, rows, np.full(len(rows), UNRELATED), self.refs[others], self.values[others, c])

    def _compare(self, z, rows, points, shared, main, targets, found) -> None:
        width = z.shape[1]
        line, own = self.z[points, main], z[rows, main]
        left = right = int(np.searchsorted(line, own[len(own) // 2]))
        size = FIRST
        while True:
            # the largest sum of squares that may still be among a row's best, for any wanted feature
            worst = found.keys[np.ix_(rows, targets)][:, :, -1].max(axis=1)
            limit = np.where(worst >= UNRELATED, np.inf, ((worst + 1.0) / 1e6) ** 2 * len(shared) / width * (1 + 1e-9))
            reach = np.sqrt(limit) * (1 + 1e-9)
            a = max(left - size, int(np.searchsorted(line, (own - reach).min(), "left")))
            b = min(right + size, int(np.searchsorted(line, (own + reach).max(), "right")))
            if a >= left and b <= right:
                return
            others = points[np.concatenate([np.arange(a, left), np.arange(right, b)])]
            # squares are added feature by feature, in their order, as a product of matrices would lose the last places
            gap = np.zeros((len(rows), len(others)))
            for c in shared:
                apart = z[rows, c][:, None] - self.z[others, c][None, :]
                gap += apart * apart
            i, j = np.nonzero(gap <= limit[:, None])
            keys = np.rint(np.sqrt(gap[i, j] / len(shared) * width) * 1e6).astype(np.int64)
            for c in targets:
                found.add(c, rows[i], keys, self.refs[others[j]], self.values[others[j], c])
            left, right, size = min(a, left), max(b, right), min(4 * size, MOST)
