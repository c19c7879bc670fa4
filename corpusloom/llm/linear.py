"""A linear hinge-loss model over indicator features, scaled by class log-count ratios.

Fitted on the driver from a bounded sample of rows, each a sorted array of feature
numbers; scoring is a sum of weights per document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LinearModel:
    """A document's margin is bias + the sum of weights of its features; the score is its sigmoid."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))

    def margins(self, docs: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(docs, self.weights[features], n)


def class_counts(rows: list[np.ndarray], positive: np.ndarray, n_features: int, step: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's positive mass and its number of rows, some rows at a time to spare the driver's memory."""
    mass, count = np.zeros(n_features), np.zeros(n_features, np.int64)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        flat = np.concatenate(part)
        mass += np.bincount(flat, np.repeat(positive[at : at + step], [len(r) for r in part]), n_features)
        count += np.bincount(flat, minlength=n_features)
    return mass, count


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, n_features: int, least_z: float) -> np.ndarray:
    """Log ratio of a feature's smoothed share of positive mass to its share of negative mass.

    Features that could well be independent of the class are 0: the signed root of their
    likelihood ratio statistic is below ``least_z``. It needs no smoothing, so a feature that
    one class never has counts as much as it should. ``positive`` is each row's probability
    of being positive.
    """
    mass, count = class_counts(rows, positive, n_features)
    there = np.flatnonzero(count)
    p = mass[there]
    q = np.maximum(count[there] - p, 0)
    all_p = positive.sum()
    all_q = len(rows) - all_p
    ratio = np.log((p + 0.5) / (all_p + 1)) - np.log((q + 0.5) / (all_q + 1))

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        seen = np.maximum(seen, 0)
        return seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))

    share = (p + q) / max(len(rows), 1)
    statistic = 2 * (part(p, share * all_p) + part(q, share * all_q) + part(all_p - p, (1 - share) * all_p) + part(all_q - q, (1 - share) * all_q))
    out = np.zeros(n_features)
    out[there] = np.where(statistic >= least_z**2, ratio, 0.0)
    return out


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, signs: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: one dual variable per row, between 0 and its cost."""
    weights, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    squares = np.array([float((values[r] ** 2).sum()) + 1.0 for r in rows])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            r = rows[i]
            gradient = signs[i] * (float(weights[r] @ values[r]) + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[r] += step * values[r]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights * values, bias


def sigmoid_fit(margins: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of targets (0 to 1) on margins, by Newton's method."""
    positive, negative = target.sum(), (1 - target).sum()
    soft = target * (positive + 1) / (positive + 2) + (1 - target) / (negative + 2)
    at = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - soft))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def fit_one(rows, belief, n_features, least_z, cost):
    values = log_count_ratios(rows, belief, n_features, least_z)
    used = [r[values[r] != 0] for r in rows]
    signs = np.where(belief >= 0.5, 1.0, -1.0)
    return dual_coordinate_descent(used, values, signs, cost * np.abs(2 * belief - 1))


def fit(rows: list[np.ndarray], belief: np.ndarray, target: np.ndarray, n_features: int, least_z: float = 4.0, cost: float = 0.1, folds: int = 3) -> LinearModel:
    """Fit to beliefs (0 to 1), calibrate on targets (nan where there is none) by margins of folds left out.

    Where the sample has rows of one class only, every score is that class's smoothed share.
    """
    known = ~np.isnan(target)
    if not known.any() or len(set((belief >= 0.5).tolist())) < 2:
        share = (float(target[known].sum()) + 1) / (known.sum() + 2) if known.any() else 0.5
        return LinearModel(np.zeros(n_features), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % folds
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        weights, bias = fit_one([rows[i] for i in inside], belief[inside], n_features, least_z, cost)
        for i in np.flatnonzero(fold == k):
            margins[i] = bias + weights[rows[i]].sum()
    weights, bias = fit_one(rows, belief, n_features, least_z, cost)
    slope, offset = sigmoid_fit(margins[known], target[known])
    return LinearModel(weights, bias, slope, offset)
