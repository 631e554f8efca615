"""Exact linear quantile regression over distributed rows.

The check loss is smoothed over a band around zero that narrows while Newton steps on summed moments follow its minimum; each step is one aggregation. When few rows lie in the band, the signs of
all others are taken as known: they add a linear term, and what is left is a small linear program over the rows of the band, solved exactly on the driver by
moving from vertex to vertex. One more pass looks whether any sign taken as known has changed. If none has, the vertex is the optimum of the whole problem; otherwise the band is laid around the new plane and
the step repeated. Nothing stops early: what can't be brought to the optimum is an error.

The driver holds moments and at most `band` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plane(features: list[str], b: np.ndarray) -> Column:
    return sum((F.col(c) * float(w) for c, w in zip(features, b[1:], strict=True)), F.lit(float(b[0])))


class Unbounded(ValueError):
    """The rows of a band do not hold the linear term of the others: the band is too narrow."""


def small_program(x: np.ndarray, y: np.ndarray, far: np.ndarray, q: float, start: np.ndarray) -> np.ndarray:
    """Minimum of the check loss over a few rows less far'b: from the vertex next to `start` along edges, each to the best point of its line, until no edge leads down.

    Labels are moved apart by less than a ten-millionth while edges are followed, so that ties can't hold a vertex back; the plane is that through the true labels of the last vertex.
    """
    n, p = x.shape
    true, y = y, y + 1e-7 * np.random.default_rng(n).uniform(-1, 1, n)
    basis: list[int] = []
    for i in np.argsort(np.abs(y - x @ start), kind="stable").tolist():  # the nearest rows that are independent
        if np.linalg.matrix_rank(x[[*basis, i]], tol=1e-9) > len(basis):
            basis.append(i)
            if len(basis) == p:
                break
    if len(basis) < p:
        raise ValueError("the features are linearly dependent")
    seen = set()
    while True:
        inverse = np.linalg.inv(x[basis])
        b = inverse @ y[basis]
        r = y - x @ b
        r[basis] = 0.0
        # along -inverse[:, j] the residual of basis row j grows at rate 1
        slope = np.where(np.abs(r) <= 1e-12 * (1 + np.abs(y)), 0.0, q - (r < 0)) @ x + far
        zero = np.flatnonzero(np.abs(r) <= 1e-12 * (1 + np.abs(y)))
        best = None
        for j in range(p):
            for sign in (1.0, -1.0):
                d = sign * inverse[:, j]
                move = x @ d
                # rate of the loss: rows that are not zero by their sign, rows that are zero by where they go
                rate = -slope @ d + sum(max(-q * m, (1 - q) * m) for m in move[zero].tolist())
                if rate < -1e-9 * (1 + np.abs(slope).max()) and (best is None or rate < best[0]):
                    best = rate, d, move, j
        if best is None or frozenset(basis) in seen:
            return inverse @ true[basis]
        seen.add(frozenset(basis))
        rate, d, move, j = best
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(np.abs(move) > 1e-14, r / move, np.inf)
        ahead = np.flatnonzero((t > 1e-14) & np.isfinite(t))
        for i in ahead[np.argsort(t[ahead], kind="stable")].tolist():
            rate += abs(move[i])  # the row's sign turns here
            if rate >= 0:
                basis[j] = i
                break
        else:
            raise Unbounded


def quantile_fit(df: DataFrame, features: list[str], label: str, q: float, *, band: int = 2_000, rounds: int = 200) -> np.ndarray | None:
    """Intercept and weights of the plane with the least check loss at quantile q; None without rows. Rows with a null are left out.

    df is read once a step: write it first. Features are moved and scaled within, so that their units don't matter.
    """
    names = [*features, label]
    rows = df.dropna(subset=names).select(*names)
    f = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    if not f.n:
        return None
    mean = np.array([f[f"m{i}"] for i in range(len(names))])
    used = [i for i in range(len(features)) if f[f"s{i}"] > 0]  # a constant feature has no weight of its own
    size = np.array([f[f"s{i}"] or 1.0 for i in range(len(names))])
    scaled = rows.select(F.lit(1.0).alias("x0"), *[((F.col(features[i]) - float(mean[i])) / float(size[i])).alias(f"x{k + 1}") for k, i in enumerate(used)], ((F.col(label) - float(mean[-1])) / float(size[-1])).alias("y"))
    p = len(used) + 1
    xs = [f"x{k}" for k in range(p)]
    fit = lambda b: sum((F.col(c) * float(w) for c, w in zip(xs, b, strict=True)), F.lit(0.0))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def step(b: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Gradient, curvature and value of the smoothed loss, and rows in the band."""
        r = F.col("y") - fit(b)
        t = F.greatest(F.least(r / h, F.lit(1.0)), F.lit(-1.0))
        inside = F.abs(r) < h
        loss = (q - 0.5) * r + F.when(inside, r * r / (4 * h) + h / 4).otherwise(F.abs(r) / 2)
        row = scaled.select(*xs, (F.lit(q - 0.5) + t / 2).alias("g"), inside.cast("double").alias("in"), loss.alias("loss")).agg(
            *[F.sum(F.col(c) * F.col("g")) for c in xs], *[F.sum(F.col(xs[i]) * F.col(xs[j]) * F.col("in")) for i, j in pairs], F.sum("loss"), F.sum("in")).first()
        curve = np.zeros((p, p))
        for (i, j), v in zip(pairs, row[p : p + len(pairs)], strict=True):
            curve[i, j] = curve[j, i] = v / (2 * h)
        return np.array(row[:p]), curve, row[-2], int(row[-1])

    b, h, count = np.zeros(p), 1.0, f.n
    if f.n > band:
        g, curve, value, count = step(b, h)
        for _ in range(rounds):
            if count <= band:
                break
            move = np.linalg.solve(curve + np.eye(p) * 1e-9 * f.n / h, g)
            k = 1.0
            while True:
                g2, curve2, value2, count2 = step(b + k * move, h)
                if value2 <= value + 1e-12 * abs(value) or k < 1e-6:
                    break
                k /= 4
            b = b + k * move
            if np.abs(k * move).max() < h / 4:  # the minimum of this smoothing is near: a narrower one
                h /= 2
            g, curve, value, count = step(b, h)
        else:
            raise RuntimeError(f"more than {band} rows lie within {h:.1e} deviations of the plane")
    for _ in range(rounds):
        r = F.col("y") - fit(b)
        near = scaled.where(F.abs(r) < h) if f.n > band else scaled
        known = scaled.where(F.abs(r) >= h) if f.n > band else scaled.limit(0)
        part = np.array(near.limit(8 * band).collect(), float).reshape(-1, p + 1)
        if len(part) >= 8 * band or len(part) < p:
            h *= 0.5 if len(part) >= p else 2.0
            continue
        far = np.array([v or 0.0 for v in known.select(*[(F.col(c) * (F.lit(q) - (r < 0).cast("double"))).alias(c) for c in xs]).agg(*[F.sum(c) for c in xs]).first()])
        try:
            new = small_program(part[:, :p], part[:, p], far, q, b)
        except Unbounded:
            h *= 1.5
            continue
        turned = known.where(((F.col("y") - fit(new)) < 0) != (r < 0)).count()
        b = new
        if not turned:
            weights = np.zeros(len(features))
            weights[used] = b[1:] * size[-1] / size[:-1][used]
            return np.append(mean[-1] + b[0] * size[-1] - weights @ mean[:-1], weights)
        h *= 1.5
    raise RuntimeError("the signs of the rows outside the band don't settle")


def quantile_regression(train: DataFrame, test: DataFrame, features: list[str], label: str, quantiles: tuple[float, float, float]) -> DataFrame:
    """test with lo, mid, hi: exact fits at three quantiles; crossed bounds are swapped, without training rows all are null."""
    fits = [quantile_fit(train, features, label, q) for q in quantiles]
    a, m, b = (F.lit(None).cast("double") if w is None else plane(features, w) for w in fits)
    return test.withColumns({"_a": a, "mid": m, "_b": b}).withColumns({"lo": F.least("_a", "_b"), "hi": F.greatest("_a", "_b")}).drop("_a", "_b")


def optimality(df: DataFrame, features: list[str], label: str, q: float, b: np.ndarray, tolerance: float = 1e-9) -> DataFrame:
    """One row: quantile, n, holds: whether for the intercept and each feature the sum over rows off the plane of (q or q - 1 by sign) times x is at most what the rows on the plane can outweigh.

    That is what an optimum must have; rows within the tolerance lie on the plane.
    """
    r = F.col(label) - plane(features, b)
    on = F.abs(r) <= tolerance
    sums = []
    for c in [F.lit(1.0), *map(F.col, features)]:
        pull = F.sum(F.when(on, F.lit(0.0)).otherwise(c * (F.lit(q) - (r < 0).cast("double"))))
        sums.append(F.abs(pull) <= F.sum(F.when(on, F.abs(c) * max(q, 1 - q)).otherwise(F.lit(0.0))) + 1e-6)
    holds = sums[0]
    for s in sums[1:]:
        holds = holds & s
    return df.dropna(subset=[*features, label]).agg(F.count("*").alias("n"), holds.alias("holds")).select(F.lit(q).alias("quantile"), "n", "holds")
