"""Hashed linear scorers: sparse logistic regression fitted on a bounded sample, and scoring."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Rows of (index, value) pairs."""

    def __init__(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray):
        self.index, self.value = index, value
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index] * self.value, minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.row] * self.value, minlength=size)


def fit(rows: Sparse, target: np.ndarray, weight: np.ndarray, size: int, l2: float, steps: int = 200, rate: float = 0.05,
        swapped: Sparse | None = None, origin: np.ndarray | None = None, penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on soft targets.

    ``swapped`` holds counterfactual rows and ``origin`` the row each was made from; ``penalty`` weighs the squared change
    of the linear score between the two.
    """
    w, bias = np.zeros(size), float(np.log((weight @ target + 1) / (weight @ (1 - target) + 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    total = weight.sum() or 1.0
    for t in range(1, steps + 1):
        z = rows.dot(w)
        g = weight * (sigmoid(z + bias) - target) / total
        grad, gb = rows.back(g, size) + l2 * w, g.sum()
        if swapped is not None and swapped.n:
            change = (swapped.dot(w) - z[origin]) * (2 * penalty / swapped.n)
            grad += swapped.back(change, size)
            against = np.bincount(origin, weights=change, minlength=rows.n)
            grad -= rows.back(against, size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        bias -= step * mb / (np.sqrt(vb) + 1e-9)
    return w, bias
