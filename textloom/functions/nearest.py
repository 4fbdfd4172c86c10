"""Exact nearest vectors of many queries over blocks of rows: a matrix product tells apart what
may be among the nearest, and only that is computed in component order, as SQL does it."""

from __future__ import annotations

import numpy as np

PAIRS = 1 << 22  #: distances held at once
EXACT = 1 << 16  #: pairs of vectors held at once
EPS = 2.0**-52


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances row by row, summed in component order (the same bits in any block)."""
    out, qq, xx = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for j in range(q.shape[1]):
        a, b = q[:, j], x[:, j]
        out += (a - b) * (a - b) if metric == "l2" else a * b
        if metric in ("cosine", "angle"):
            qq += a * a
            xx += b * b
    if metric == "l2":
        return out
    if metric == "dot":
        return -out
    size = np.sqrt(qq) * np.sqrt(xx)
    out = np.divide(out, size, out=np.zeros(len(out)), where=~(size <= 0))
    return 1.0 - out if metric == "cosine" else -out


class Nearest:
    """The ``k`` nearest rows of each query, of the rows added so far, ties to smaller ids.
    Metrics are those of ``functions.vector``, and ``angle``, the cosine negated. Rows whose id
    is a query's ``own`` are none of its candidates. NaN is farthest."""

    def __init__(self, queries: np.ndarray, k: int, metric: str = "l2", own: np.ndarray | None = None):
        self.q, self.k, self.metric, self.own = queries, k, metric, own
        with np.errstate(all="ignore"):
            self.q2 = (queries * queries).sum(1)
            self.unit = queries / np.sqrt(self.q2)[:, None] if metric in ("cosine", "angle") else queries
        self.worst = np.full(len(queries), np.inf)  # the k-th distance; infinite as long as there are fewer rows
        self.of, self.ids, self.far = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows with vectors ``x``, in double precision."""
        fine = np.isfinite(x).all(1)
        for part in (fine, ~fine) if not fine.all() else (slice(None),):
            i, m = ids[part], x[part]
            step = max(1, min(len(m), 8_192))
            wide = max(1, PAIRS // step)
            for a in range(0, len(m), step):
                for b in range(0, len(self.q), wide):
                    self._block(i[a : a + step], m[a : a + step], b, min(b + wide, len(self.q)))

    def _block(self, ids: np.ndarray, x: np.ndarray, lo: int, hi: int) -> None:
        with np.errstate(all="ignore"):
            x2, n = (x * x).sum(1), x.shape[1]
            if self.metric in ("cosine", "angle"):
                near = -(x / np.sqrt(x2)[:, None] @ self.unit[lo:hi].T)
                if self.metric == "cosine":
                    near += 1.0
                slack = np.full(hi - lo, 4 * (n + 8) * EPS)
            else:
                near = x @ self.unit[lo:hi].T
                slack = 4 * (n + 8) * EPS * (x2.max() + self.q2[lo:hi])
                if self.metric == "dot":
                    np.negative(near, out=near)
                else:
                    near *= -2.0
                    near += x2[:, None]
                    near += self.q2[lo:hi]
            if self.own is not None:
                order = np.argsort(ids, kind="stable")
                left, right = (np.searchsorted(ids[order], self.own[lo:hi], side) for side in ("left", "right"))
                for j in np.flatnonzero(right > left):
                    near[order[left[j] : right[j]], j] = np.inf
            bar = self.worst[lo:hi].copy()
            fresh = np.flatnonzero(np.isinf(bar))
            if len(fresh) and len(x) > self.k:
                # in these rows alone k are as near as this
                bar[fresh] = np.partition(near[:, fresh], self.k - 1, axis=0)[self.k - 1] + slack[fresh]
            far = near > bar + slack
        row, of = np.nonzero(~far)
        for at in range(0, len(row), EXACT):
            self._merge(ids, x, row[at : at + EXACT], of[at : at + EXACT] + lo)

    def pairs(self, ids: np.ndarray, x: np.ndarray, of: int) -> None:
        """Rows that are candidates of one query alone."""
        for at in range(0, len(x), EXACT):
            row = np.arange(at, min(at + EXACT, len(x)))
            self._merge(ids, x, row, np.full(len(row), of))

    def _merge(self, ids: np.ndarray, x: np.ndarray, row: np.ndarray, of: np.ndarray) -> None:
        if self.own is not None:
            keep = ids[row] != self.own[of]
            row, of = row[keep], of[keep]
        with np.errstate(all="ignore"):
            far = _exact(self.q[of], x[row], self.metric)
        keep = ~(far > self.worst[of])
        row, of, far = row[keep], of[keep], far[keep]
        if not len(row):
            return
        touched = np.zeros(len(self.q), bool)
        touched[of] = True
        held = touched[self.of]
        ids = ids[row] if self.ids is None else np.concatenate((self.ids[held], ids[row]))
        far, of = np.concatenate((self.far[held], far)), np.concatenate((self.of[held], of))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], far, of))
        ids, far, of = ids[order], far[order], of[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        full = place == self.k - 1
        self.worst[of[full]] = np.where(np.isnan(far[full]), np.inf, far[full])
        best = place < self.k
        rest = ~held
        self.ids = ids[best] if self.ids is None else np.concatenate((self.ids[rest], ids[best]))
        self.far, self.of = np.concatenate((self.far[rest], far[best])), np.concatenate((self.of[rest], of[best]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, ids, distances), nearest first within a query."""
        order = np.argsort(self.of, kind="stable")
        ids = np.zeros(0, np.int64) if self.ids is None else self.ids[order]
        return self.of[order], ids, self.far[order]
