"""Logistic regression by follow-the-regularised-leader, and scoring with it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of (feature, value) pairs: row i is index[ptr[i]:ptr[i+1]]."""

    ptr: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @property
    def n(self) -> int:
        return len(self.ptr) - 1

    @classmethod
    def of(cls, row: np.ndarray, feature: np.ndarray, n: int) -> Sparse:
        """Counts of each feature by row; ``row`` need not be in order."""
        key, count = np.unique(row.astype(np.int64) << 32 | feature.astype(np.int64), return_counts=True)
        ptr = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 32)
        return cls(ptr, key & 0xFFFFFFFF, count.astype(np.float64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.index] * self.value)))
        return sums[self.ptr[1:]] - sums[self.ptr[:-1]]


def joined(parts: list[Sparse]) -> Sparse:
    ptr = [np.zeros(1, np.int64)]
    for p in parts:
        ptr.append(p.ptr[1:] + ptr[-1][-1])
    return Sparse(np.concatenate(ptr), np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(x: Sparse, target: np.ndarray, size: int, *, alpha: float, beta: float = 1.0, l1: float, l2: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights (size + 1; the last is the bias) after ``epochs`` passes of FTRL-proximal
    updates, one row at a time in a fixed shuffled order. Targets lie in [0, 1]."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)

    def weights(i):
        free = np.abs(z[i]) > l1
        return np.where(free, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for r in rng.permutation(x.n):
            s, e = x.ptr[r], x.ptr[r + 1]
            i = np.append(x.index[s:e], size)
            v = np.append(x.value[s:e], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - target[r]) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size + 1))
