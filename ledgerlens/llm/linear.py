"""A logistic regression over sparse 0/1 features, for bounded samples."""

from __future__ import annotations

import numpy as np


def margins(rows: np.ndarray, columns: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """weights . x + bias per example; (rows, columns) list the ones of x."""
    return np.bincount(rows, weights=weights[columns], minlength=n) + bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, importance: np.ndarray,
             features: int, l2: float = 1.0, steps: int = 150, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted log loss plus l2 / 2 * |w|^2.

    ``target`` may be soft (0 to 1).  Full-batch AdaGrad; without examples
    the weights are 0.
    """
    weights, bias = np.zeros(features), 0.0
    n = len(target)
    if not n:
        return weights, bias
    share = importance / importance.sum()
    p = float(np.clip((share * target).sum(), 1e-4, 1 - 1e-4))
    bias = float(np.log(p / (1 - p)))
    seen_w, seen_b = np.full(features, 1e-8), 1e-8
    for _ in range(steps):
        error = share * (sigmoid(margins(rows, columns, n, weights, bias)) - target)
        grad = np.bincount(columns, weights=error[rows], minlength=features) + l2 / importance.sum() * weights
        seen_w += grad * grad
        seen_b += float(error.sum()) ** 2
        weights -= rate * grad / np.sqrt(seen_w)
        bias -= rate * float(error.sum()) / np.sqrt(seen_b)
    return weights, bias


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * margin + b) is calibrated to the labels.

    Newton steps on smoothed targets; a is never negative, and one class
    alone gives a constant.
    """
    good, bad = float(label.sum()), float(len(label) - label.sum())
    prior = np.log((good + 1) / (bad + 1))
    if not good or not bad:
        return 0.0, float(prior)
    target = np.where(label > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.0, float(prior)
    for _ in range(50):
        p = sigmoid(a * margin + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    return (a, b) if a > 0 else (0.0, float(prior))
