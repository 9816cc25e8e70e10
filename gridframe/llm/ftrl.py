"""Follow-the-regularised-leader (proximal) for sparse rows, with elastic-net penalties (McMahan et al., 2013)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Ftrl:
    """One weight per feature and class, each with its own learning rate. One class: logistic; several: softmax.

    The last feature is the bias, which is present in every row and bears no penalty.
    """

    def __init__(self, features: int, classes: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(self.z), self.l1)
        l1[-1] = 0.0
        reach = np.abs(z) - l1[at][:, None]
        return np.where(reach > 0, -np.sign(z) * reach / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        z, n = self.z[at], self.n[at]
        reach = np.abs(z) - self.l1
        reach[-1] = np.abs(z[-1])
        w = np.where(reach > 0, -np.sign(z) * reach / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)
        g = x[:, None] * (chances(x @ w) - target)
        grown = n + g * g
        self.z[at] = z + g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int, seed: int = 7) -> None:
        """Rows are (features, values); the order of each epoch is drawn from a fixed seed."""
        draw = np.random.default_rng(seed)
        last = len(self.z) - 1
        for _ in range(epochs):
            for i in draw.permutation(len(rows)):
                at, x = rows[i]
                self.step(np.append(at, last), np.append(x, 1.0), targets[i])


def chances(logits: np.ndarray) -> np.ndarray:
    """Probabilities of the classes on the last axis; with one class, that of label 1."""
    if logits.shape[-1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
