"""Sparse multinomial logistic regression by follow-the-regularised-leader, and temperature calibration.

Both work on a bounded sample of sparse rows in one process.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: Sequence[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    size: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 7,
) -> np.ndarray:
    """Weights (size + 1, classes); the last row is the bias, which is not penalised by l1.

    FTRL-proximal with the elastic net: a weight stays exactly zero until its
    gradients outweigh l1.  Rows are (indices, values); their order is shuffled by a fixed seed.
    """
    z = np.zeros((size + 1, classes))
    n = np.zeros((size + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        limit = np.where(at == size, 0.0, l1)[:, None]
        zs = z[at]
        return np.where(
            np.abs(zs) > limit, -(zs - np.sign(zs) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0
        )

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = np.append(rows[k][0], size)
            x = np.append(rows[k][1], 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[labels[k]] -= 1
            g = x[:, None] * error
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the scores with the least log loss on rows not trained on; 1 without rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
