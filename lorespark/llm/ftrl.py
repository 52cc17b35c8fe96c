"""Follow-the-regularised-leader (proximal) logistic regression on sparse rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FtrlParams:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.0001
    epochs: int = 4
    bits: int = 18


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], params: FtrlParams = FtrlParams()) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over ``(buckets, values, label)`` rows in the order given.

    The bias starts at the log-odds of the labels. No rows: all-zero weights and bias, so every score is 0.5.
    """
    size = 1 << params.bits
    z, n = np.zeros(size), np.zeros(size)
    if not rows:
        return z, 0.0
    share = min(max(float(np.mean([y for *_, y in rows])), 1e-3), 1 - 1e-3)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    for _ in range(params.epochs):
        for idx, x, y in rows:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= params.l1, 0.0, -(zi - np.sign(zi) * params.l1) / ((params.beta + root) / params.alpha + params.l2))
            g0 = 1 / (1 + np.exp(-min(max(float(w @ x) + bias, -35.0), 35.0))) - y
            g = g0 * x
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / params.alpha * w
            n[idx] = ni + g * g
            bias_n += g0 * g0
            bias -= 0.1 * g0 / (1 + np.sqrt(bias_n))
    root = np.sqrt(n)
    w = np.where(np.abs(z) <= params.l1, 0.0, -(z - np.sign(z) * params.l1) / ((params.beta + root) / params.alpha + params.l2))
    return w, bias


def score(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each of ``n`` rows: a sparse dot product."""
    raw = np.bincount(r, v * weights[c], minlength=n) + bias if len(r) else np.full(n, bias)
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
