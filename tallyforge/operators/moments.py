"""Linear models from moments: one scan gives the moment matrix of each group of rows (year, fold), sums of them every training set.

A walk-forward training set is the sum over earlier years, that of a cross-validation fold the sum over the other folds; errors on rows that are left out follow from their moments as well.
Moments are means and comoments, merged pairwise, so nothing cancels. What the driver holds is a matrix a group, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """n rows with means and comoments (sums of products about the means); the label stands last."""

    n: int
    mean: np.ndarray
    about: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.about + other.about + np.outer(d, d) * (self.n * other.n / n))

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)))


@dataclass(frozen=True)
class Line:
    """A fitted linear model."""

    features: tuple[str, ...]
    intercept: float
    weights: np.ndarray

    def column(self) -> Column:
        """The prediction as an expression."""
        return sum((F.col(f) * float(w) for f, w in zip(self.features, self.weights, strict=True)), F.lit(float(self.intercept)))

    def error(self, m: Moments) -> float:
        """Sum of squared errors on rows with these moments."""
        w = np.append(-self.weights, 1.0)
        return float(w @ m.about @ w + m.n * (w @ m.mean - self.intercept) ** 2)


def group_moments(df: DataFrame, features: list[str], label: str, by: list[str]) -> dict[tuple, Moments]:
    """Moments of the rows of each group whose features and label are all known: one aggregation. Groups must be few, as each is a matrix on the driver."""
    names = [*features, label]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = df.dropna(subset=names).groupBy(*by).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"_c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        about = np.zeros((len(names), len(names)))
        for i, j in pairs:
            about[i, j] = about[j, i] = r[f"_c{i}_{j}"] * r["_n"]
        out[tuple(r[c] for c in by)] = Moments(r["_n"], np.array([r[f"_m{i}"] for i in range(len(names))], float), about)
    return out


def total(parts: list[Moments], width: int) -> Moments:
    out = Moments.none(width)
    for p in parts:
        out = out + p
    return out


def _standard(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations (1 for constant features), correlation-like matrix and its products with the label, about the means and over n."""
    spread = np.sqrt(np.diag(m.about)[:-1] / m.n)
    spread = np.where(spread > 0, spread, 1.0)
    return spread, m.about[:-1, :-1] / np.outer(spread, spread) / m.n, m.about[:-1, -1] / spread / m.n


def ridge(m: Moments, features: list[str], alpha: float = 0.0) -> Line | None:
    """Least squares with a penalty alpha on the squares of the weights of standardised features, against the sum of squares; the intercept is free. None without rows."""
    if not m.n:
        return None
    spread, a, b = _standard(m)
    w = np.linalg.lstsq(a + np.eye(len(b)) * (alpha / m.n), b, rcond=1e-12)[0] / spread
    return Line(tuple(features), float(m.mean[-1] - w @ m.mean[:-1]), w)


def lasso(m: Moments, features: list[str], alpha: float, sweeps: int = 5000, tolerance: float = 1e-10) -> Line | None:
    """Half the mean square plus alpha times the absolute weights of standardised features, by coordinate descent on the moments until no weight moves. None without rows."""
    if not m.n:
        return None
    spread, a, b = _standard(m)
    w = np.zeros(len(b))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if a[j, j] <= 0:
                continue
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / a[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= tolerance * max(1.0, np.abs(w).max()):
            break
    w = w / spread
    return Line(tuple(features), float(m.mean[-1] - w @ m.mean[:-1]), w)


def cross_validated_ridge(folds: list[Moments], features: list[str], penalties: list[float]) -> tuple[Line | None, float]:
    """The ridge on all folds with the penalty whose mean R squared over the folds is largest (nine digits; the first on ties), and that penalty."""
    width, best = len(features) + 1, None
    for p in penalties:
        scores = []
        for i, held in enumerate(folds):
            line = ridge(total(folds[:i] + folds[i + 1 :], width), features, p)
            if line and held.n and held.about[-1, -1] > 0:
                scores.append(1 - line.error(held) / held.about[-1, -1])
        mean = round(float(np.mean(scores)), 9) if scores else -np.inf
        if best is None or mean > best[0]:
            best = mean, p
    return ridge(total(folds, width), features, best[1]), best[1]
