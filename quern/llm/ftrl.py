"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader (FTRL-Proximal; McMahan et al., 2013) with
elastic-net penalties, and temperature calibration (Guo et al., 2017)."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: the features at (no repeats) have the values x."""
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def loss(logits: np.ndarray, labels: np.ndarray, heat: float) -> float:
    """Mean cross-entropy at a temperature against smoothed targets (Platt, 1999): of n examples, the label has (n + 1) / (n + 2) and the other classes
    share the rest, so the least loss lies at a finite temperature even where every example is told right."""
    n, k = logits.shape
    x = logits / heat
    x = x - x.max(1, keepdims=True)
    p = x - np.log(np.exp(x).sum(1, keepdims=True))
    own = p[np.arange(n), labels]
    rest = (p.sum(1) - own) / max(1, k - 1)
    return float(-(own * (n + 1) + rest).mean() / (n + 2))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which held-back examples are likeliest. The loss is convex in its inverse; the search range doubles until the
    least loss is inside it, then narrows down."""
    if logits.shape[0] == 0 or logits.shape[1] < 2 or not np.abs(logits - logits[:, :1]).any():
        return 1.0
    low, high = -4.0, 4.0
    for _ in range(60):
        grid = np.linspace(low, high, 65)
        best = int(np.argmin([loss(logits, labels, float(np.exp(g))) for g in grid]))
        if best in (0, 64) and high - low < 64:
            low, high = (low - (high - low), high) if best == 0 else (low, high + (high - low))
            continue
        if high - low < 1e-3:
            return float(np.exp(grid[best]))
        step = grid[1] - grid[0]
        low, high = grid[best] - 2 * step, grid[best] + 2 * step
    return float(np.exp(grid[best]))
