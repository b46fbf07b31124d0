"""Logistic models over hashed sparse features, in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np


def slot(name: str, bits: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


@dataclass
class Sparse:
    """Rows of hashed features: row k has index[start[k]:start[k + 1]] and as many values."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, indices: list[np.ndarray], values: list[np.ndarray] | None = None) -> "Sparse":
        start = np.concatenate([[0], np.cumsum([len(x) for x in indices])]).astype(np.int64)
        index = np.concatenate([*indices, np.empty(0, np.int64)]).astype(np.int64)
        value = np.ones(len(index)) if values is None else np.concatenate([*values, np.empty(0)]).astype(np.float64)
        return cls(start, index, value)

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], minlength=len(self))

    def take(self, rows: np.ndarray) -> "Sparse":
        return Sparse.of([self.index[self.start[r] : self.start[r + 1]] for r in rows], [self.value[self.start[r] : self.start[r + 1]] for r in rows])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    weights: np.ndarray  # by slot
    dense: np.ndarray  # of further columns
    bias: float

    def score(self, x: Sparse, columns: np.ndarray | None = None) -> np.ndarray:
        z = x.dot(self.weights) + self.bias
        return sigmoid(z if columns is None or not columns.size else z + columns @ self.dense)


def fit(x: Sparse, target: np.ndarray, dim: int, columns: np.ndarray | None = None, features: int = 4096, l2: float = 1e-4, steps: int = 120, rate: float = 0.2) -> Logistic:
    """Adam over all rows; target may be soft. Of the slots, the ``features`` that tell most of the target are used."""
    target = np.asarray(target, np.float64)
    columns = np.empty((len(x), 0)) if columns is None else columns
    weights, share = np.zeros(dim), min(max(target.mean() if len(target) else 0.5, 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    if len(target) == 0 or target.max() - target.min() < 1e-9:
        return Logistic(weights, np.zeros(columns.shape[1]), bias)
    row = x.row
    mass = np.bincount(x.index, x.value, minlength=dim)
    hit = np.bincount(x.index, x.value * target[row], minlength=dim)
    telling = np.abs(hit - mass * share) / np.sqrt(mass + 1)
    telling[np.bincount(x.index, minlength=dim) < 3] = 0
    used = np.sort(np.argsort(-telling, kind="stable")[:features])
    used = used[telling[used] > 0]
    place = np.full(dim, -1, np.int64)
    place[used] = np.arange(len(used))
    own = place[x.index] >= 0
    row, col, val = row[own], place[x.index[own]], x.value[own]
    theta = np.zeros(len(used) + columns.shape[1] + 1)
    theta[-1] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, k = len(target), len(used)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * theta[col], minlength=n) + columns @ theta[k:-1] + theta[-1]
        error = (sigmoid(z) - target) / n
        grad = np.concatenate([np.bincount(col, val * error[row], minlength=k), columns.T @ error, [error.sum()]])
        grad[:-1] += l2 * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[used] = theta[:k]
    return Logistic(weights, theta[k:-1].copy(), float(theta[-1]))
