"""Robust location and covariance: the minimum covariance determinant.

Of all sets of a share of the rows the one whose covariance has the least determinant is looked for. Random starts of a few rows each are led by concentration steps (moments of the nearest rows, distances
from these, the nearest again) on a bounded sample, which only tells where to start; the best of them and the start from all rows go on over all rows, by sketches of the distances first; the one with the
least determinant then goes on by exact places until it no longer falls. The covariance is then scaled to be consistent under a normal law (median distance against that of chi squared), the rows beyond its 97.5 % point are left out, and
moments and scale of the others are the result.

Scale. A step over all rows is one exact order statistic of the distances and one aggregation of moments; the driver holds matrices and the sample.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written_once
from .windows import quantiles, ranked_values


def chi_squared_quantile(p: float, freedom: int) -> float:
    """Value below which a chi-squared variable lies with probability p, by bisection of the regularised gamma function's series."""

    def below(x: float) -> float:
        a, x = freedom / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 0.0, freedom + 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and below(mid) < p else (lo, mid)
        if hi - lo < 1e-13 * hi:
            break
    return (lo + hi) / 2


def squared_distance(features: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared distance of a row, as an expression."""
    d = [F.col(c) - float(m) for c, m in zip(features, mean, strict=True)]
    terms = [d[i] * d[j] * float(inverse[i, j]) * (1.0 if i == j else 2.0) for i in range(len(d)) for j in range(i, len(d)) if inverse[i, j]]
    return F.greatest(sum(terms[1:], terms[0]) if terms else F.lit(0.0), F.lit(0.0))


#: What a variance counts as at least: features that depend on each other have determinants as well, and the others still tell sets apart.
LEAST = 1e-12


def _log_determinant(cov: np.ndarray) -> float:
    return float(np.log(np.maximum(np.linalg.eigvalsh(cov), LEAST)).sum())


def _moments(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    r = df.agg(F.count("*"), *[F.avg(c) for c in features], *[F.covar_pop(features[i], features[j]) for i, j in pairs]).first()
    cov = np.zeros((len(features), len(features)))
    for (i, j), v in zip(pairs, r[1 + len(features) :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return r[0], np.array([v or 0.0 for v in r[1 : 1 + len(features)]]), cov


def starts(x: np.ndarray, share: float, trials: int, keep: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best means and covariances of random starts on a sample, each concentrated until its determinant stops falling."""
    rng, (n, p) = np.random.default_rng(seed), x.shape
    h, found = max(p + 1, math.ceil(share * n)), []
    if n <= p + 1:
        return []
    for _ in range(trials):
        some = x[rng.choice(n, p + 1, replace=False)]
        last = np.inf
        while True:
            mean, cov = some.mean(0), np.cov(some.T, bias=True).reshape(p, p)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov, rcond=1e-10, hermitian=True), x - mean)
            some = x[np.argsort(d, kind="stable")[:h]]
            value = _log_determinant(np.cov(some.T, bias=True).reshape(p, p))
            if not value < last - 1e-9:
                break
            last = value
        found.append((last, some.mean(0), np.cov(some.T, bias=True).reshape(p, p)))
    found.sort(key=lambda f: f[0])
    return [f[1:] for f in found[:keep]]


def minimum_determinant(df: DataFrame, features: list[str], *, share: float = 0.9, trials: int = 30, keep: int = 1, sample: int = 1_500, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and log determinant of the share of rows with the least determinant found, before scaling and reweighting. df is read once a step: write it first."""
    n, mean, cov = _moments(df, features)
    h = max(1, min(n, math.ceil(share * n)))
    # by a digest of the features, so the sample is the same in every run
    drawn = df.select(*features).orderBy(F.xxhash64(*features), *features).limit(sample).collect()
    x = np.array([[float(v) for v in r] for r in drawn]).reshape(-1, len(features))

    def concentrated(at: np.ndarray, about: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, float] | None:
        """Steps until the log determinant stops falling: by a millionth, without exact places by a thousandth."""
        last = np.inf
        while True:
            d = df.select(*features, F.round(squared_distance(features, at, np.linalg.pinv(about, rcond=1e-10, hermitian=True)), 12).alias("_d"))
            if exact:
                cut = ranked_values(d, "_d").agg(F.min(F.when(F.col("upto") >= h, F.col("_d"))).alias("cut")).first().cut
            else:
                cut = d.agg(F.percentile_approx("_d", h / n, 10_000).alias("cut")).first().cut
            if cut is None:
                return None
            _, at2, about2 = _moments(d.where(F.col("_d") <= cut), features)
            value = _log_determinant(about2)
            if not value < last - (1e-6 if exact else 1e-3):  # rows as far as the last one count too, so a step may stand still
                return at, about, last
            at, about, last = at2, about2, value

    if not n:
        return mean, cov, _log_determinant(cov)
    # sketches of the distances lead every start near to its end; the best of them goes on by exact places
    led = [concentrated(*start, False) for start in [(mean, cov), *starts(x, share, trials, keep, seed)]]
    at, about, _ = min((f for f in led if f), key=lambda f: f[2], default=(mean, cov, 0.0))
    return concentrated(at, about, True) or (mean, cov, _log_determinant(cov))


def robust_distance(df: DataFrame, features: list[str], *, share: float = 0.9, seed: int = 0) -> DataFrame:
    """df with column distance: the robust Mahalanobis distance of each row by the reweighted minimum covariance determinant. A null feature counts as 0; without rows there are none."""
    base = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    own = [f"_f{i}" for i in range(len(features))]
    rows = written_once(base.select(*own), "covariance")
    mean, cov, _ = minimum_determinant(rows, own, share=share, seed=seed)

    def consistent(frame: DataFrame, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        middle = quantiles(frame.select(squared_distance(own, mean, np.linalg.pinv(cov, rcond=1e-10, hermitian=True)).alias("d")), "d", {"m": 0.5}).first().m
        return cov * (middle / chi_squared_quantile(0.5, rank(cov))) if middle else cov

    def rank(cov: np.ndarray) -> int:
        return max(1, int(np.linalg.matrix_rank(cov, hermitian=True, tol=1e-10 * max(float(np.abs(cov).max()), LEAST))))

    cov = consistent(rows, mean, cov)
    near = rows.where(squared_distance(own, mean, np.linalg.pinv(cov, rcond=1e-10, hermitian=True)) < chi_squared_quantile(0.975, rank(cov)))
    n, at, about = _moments(near, own)
    if n > len(own):
        mean, cov = at, consistent(rows, at, about)
    return base.withColumn("distance", F.sqrt(squared_distance(own, mean, np.linalg.pinv(cov, rcond=1e-10, hermitian=True)))).drop(*own)
