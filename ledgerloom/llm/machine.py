"""Sparse training data in numpy, and steps of AdaGrad on it."""

from __future__ import annotations

import numpy as np


class Rows:
    """Rows of term numbers, laid end to end."""

    def __init__(self, terms: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.terms = np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some rows, and which of these rows each is in."""
        size = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[rows], size)
        return self.terms[at], owner


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of values, or of rows of them, by owner."""
    if values.ndim == 1:
        return np.bincount(owner, values, n)
    return np.stack([np.bincount(owner, v, n) for v in values.T], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AdaGrad:
    """Steps for the touched rows of a table of weights, with decay and, for a plain vector, a soft threshold."""

    def __init__(self, weights: np.ndarray, rate: float, decay: float, threshold: float = 0.0):
        self.weights, self.squares = weights, np.full(weights.shape, 1e-6)
        self.rate, self.decay, self.threshold = rate, decay, threshold

    def step(self, at: np.ndarray, gradient: np.ndarray) -> None:
        w = self.weights[at]
        gradient = gradient + self.decay * w
        self.squares[at] += gradient**2
        rate = self.rate / np.sqrt(self.squares[at])
        w = w - rate * gradient
        if self.threshold:
            w = np.sign(w) * np.maximum(np.abs(w) - rate * self.threshold, 0)
        self.weights[at] = w
