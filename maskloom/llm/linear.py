"""Small linear models fitted on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge linear SVM, classes weighted alike; y is -1 or 1. Accelerated gradient."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    v = np.random.default_rng(0).standard_normal(d + 1).astype(x.dtype)
    for _ in range(20):  # largest curvature by power iteration
        v = x1.T @ (share * (x1 @ v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1 + 2.2 * float(v @ (x1.T @ (share * (x1 @ v)))))
    share, y = share.astype(x.dtype), y.astype(x.dtype)
    keep = np.ones(d + 1, x.dtype)
    keep[-1] = 1e-3  # the bias is hardly held back
    w = z = np.zeros(d + 1, x.dtype)
    step = x.dtype.type(step)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        grad = keep * z - 2 * (x1.T @ (share * y * slack))
        new = z - step * grad
        z = new + x.dtype.type(t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_scale(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope s that makes sigmoid(s * margin) likeliest, between 0.5 and 8."""
    slopes = np.geomspace(0.5, 8, 33)
    loss = [np.logaddexp(0, -s * y * margin).mean() for s in slopes]
    return float(slopes[int(np.argmin(loss))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
