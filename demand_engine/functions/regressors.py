"""The regressor of one SKU's weekly series, used inside grouped tasks."""

from __future__ import annotations

import numpy as np


class Moments:
    """Running sums of rows and their products, about a fixed point: what least squares needs of the rows taken so far."""

    def __init__(self, centre: np.ndarray, level: float = 0.0):
        k = len(centre)
        self.centre, self.level, self.n = centre, level, 0
        self.sum_x, self.sum_y = np.zeros(k), 0.0
        self.xx, self.xy = np.zeros((k, k)), np.zeros(k)

    def add(self, x: np.ndarray, y: np.ndarray) -> Moments:
        x, y = x - self.centre, y - self.level
        self.n += len(y)
        self.sum_x, self.sum_y = self.sum_x + x.sum(axis=0), self.sum_y + y.sum()
        self.xx, self.xy = self.xx + x.T @ x, self.xy + x.T @ y
        return self

    def ridge(self, alphas: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Weights (a column for each penalty alpha * |w|^2) and intercepts, all from one factorisation."""
        mean_x, mean_y = self.sum_x / self.n, self.sum_y / self.n
        values, vectors = np.linalg.eigh(self.xx - np.outer(self.sum_x, mean_x))
        turned = vectors.T @ (self.xy - self.sum_x * mean_y)
        weights = vectors @ (turned[:, None] / (np.maximum(values, 0.0)[:, None] + np.asarray(alphas, float)))
        return weights, self.level + mean_y - (self.centre + mean_x) @ weights


class Ridge:
    """Least squares with penalty alpha * |w|^2 on centred columns."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        weights, intercept = Moments(x.mean(axis=0), y.mean()).add(x, y).ridge([self.alpha])
        self.w, self.intercept = weights[:, 0], float(intercept[0])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.intercept


def indicators(columns: list[np.ndarray]) -> np.ndarray:
    """A 0/1 column for every value of each of the columns, values in order; None has none."""
    blocks = [np.zeros((len(columns[0]) if columns else 0, 0))]
    for values in columns:
        known = sorted({v for v in values if v is not None})
        blocks.append((values[:, None] == np.array(known, object)[None, :]).astype(float))
    return np.hstack(blocks)


def usable(x: np.ndarray) -> np.ndarray:
    """Which columns have at least two numbers."""
    return (~np.isnan(x)).sum(axis=0) >= 2
