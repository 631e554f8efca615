"""Minimum covariance determinant: planted clusters, determinants, quantiles of chi squared, edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from tallyforge.operators import covariance as C


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, " + ", ".join(f"x{j} double" for j in range(x.shape[1]))).repartition(3)


def test_chi_squared_quantiles():
    # known values to six digits
    for p, k, want in ((0.5, 1, 0.454936), (0.975, 2, 7.377759), (0.5, 8, 7.344121), (0.975, 8, 17.534546)):
        assert C.chi_squared_quantile(p, k) == pytest.approx(want, abs=1e-5)


def test_planted_clusters_stand_out_and_scale_is_that_of_the_bulk(spark):
    rng = np.random.default_rng(8)
    bulk = rng.multivariate_normal([0, 0, 0], [[4, 1, 0], [1, 1, 0.3], [0, 0.3, 2]], 460)
    far = rng.normal(size=(40, 3)) * 0.1 + [9, -6, 9]  # close together, so they pull a plain covariance
    df = frame(spark, np.vstack([bulk, far]))
    names = ["x0", "x1", "x2"]
    got = {r.k: r.distance for r in C.robust_distance(df, names, share=0.85).collect()}
    assert min(got[k] for k in range(460, 500)) > max(got[k] for k in range(460))
    inside = sorted(got[k] ** 2 for k in range(460))
    assert inside[230] == pytest.approx(C.chi_squared_quantile(0.5, 3), rel=0.2)
    # the determinant is never above that from all rows alone
    mean, cov, value = C.minimum_determinant(df, names, share=0.85)
    *_, alone = C.minimum_determinant(df, names, share=0.85, trials=0)
    assert value <= alone + 1e-5
    x = np.vstack([bulk, far])
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    near = x[np.argsort(d)[: int(np.ceil(0.85 * 500))]]
    assert np.linalg.slogdet(np.cov(near.T, bias=True))[1] == pytest.approx(value, abs=1e-4)  # a further step gains nothing


def test_few_equal_and_missing_rows(spark):
    assert C.robust_distance(frame(spark, np.zeros((5, 2))), ["x0", "x1"]).agg({"distance": "max"}).first()[0] == 0
    one = spark.createDataFrame([(1, 2.0, None)], "k int, x0 double, x1 double")
    assert [r.distance for r in C.robust_distance(one, ["x0", "x1"]).collect()] == [0.0]
    assert C.robust_distance(one.limit(0), ["x0", "x1"]).count() == 0
