"""Fitted models against plain versions: boosting, moments, ridges of series, contestants, quantile regression, isolation samples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import boosting as B
from tallyforge.operators import methods, moments, outliers, quantreg, series
from tallyforge.settings import TARGET


# --- boosting ----------------------------------------------------------------------------------------
def plain_boost(x, y, key, how, cuts):
    """One node and one split after the other: no histograms, no bins beyond the cuts themselves."""
    margin, trees = np.full(len(y), y.mean()), []
    soft = lambda g: np.sign(g) * max(abs(g) - how.l1, 0)
    score = lambda g: soft(g.sum()) ** 2 / (len(g) + how.l2) if len(g) + how.l2 else 0.0
    value = lambda g: -how.rate * soft(g.sum()) / (len(g) + how.l2) if len(g) + how.l2 else 0.0
    for r in range(how.rounds):
        g, used = margin - y, B.drawn(key, how.rows, how.seed, r)
        nodes, splits = {0: np.arange(len(y))}, {}
        for node in range(2**how.depth - 1):
            if node not in nodes:
                continue
            rows = nodes[node]
            own = rows[used[rows]]
            best = None
            for j in B.columns_of(how, r, x.shape[1]).tolist():
                for missing_left in (True, False):
                    if not missing_left and not np.isnan(x[own, j]).any():
                        continue
                    for c in cuts[j].tolist():
                        left = np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= c)
                        a, b = own[left[own]], own[~left[own]]
                        if min(len(a), len(b)) < max(how.least, 1):
                            continue
                        gain = score(g[a]) + score(g[b]) - score(g[own])
                        if gain > 1e-9 * abs(score(g[own])) and (best is None or gain > best[0] + 1e-12):
                            best = gain, j, c, missing_left, left, value(g[a]), value(g[b])
            if best:
                splits[node] = best
                nodes[2 * node + 1], nodes[2 * node + 2] = rows[best[4][rows]], rows[~best[4][rows]]
        kept, ready = set(), {0} & set(splits)
        while ready and (not how.leaves or len(kept) + 1 < how.leaves):
            node = max(ready, key=lambda n: splits[n][0])
            ready.remove(node)
            kept.add(node)
            ready |= {2 * node + 1, 2 * node + 2} & set(splits)
        step = np.full(len(y), value(g[used]))
        for node in sorted(kept):
            rows = nodes[node]
            step[rows] = np.where(splits[node][4][rows], splits[node][5], splits[node][6])
        margin = margin + step
        trees.append({n: splits[n][1:4] for n in kept})
    return margin, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 3)), 2)
    x[::7, 1] = np.nan
    y = np.sin(x[:, 0]) + np.nan_to_num(x[:, 1], nan=2.0) ** 2 + 0.1 * rng.normal(size=240)
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label double").repartition(3)
    key = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    return df, x, y, np.array([key[i] for i in range(240)], np.int64).astype(np.uint64)


@pytest.mark.parametrize("how", [B.Boosting(8, 3, 0.3, bins=16), B.Boosting(6, 2, 0.2, rows=0.7, columns=0.67, l1=0.3, l2=2.0, bins=16), B.Boosting(6, 3, 0.3, leaves=4, l2=0.0, least=5, bins=16)])
def test_boosting_equals_plain_trees(spark, rows, monkeypatch, how):
    """Same splits, same margins; in one task and by passes over several blocks, also past a move of the margins."""
    df, x, y, key = rows
    # where the sketches cut has a bearing on the trees, so the plain version takes the same cuts; each lies within a bin's width of the exact quantile
    at = [k / how.bins for k in range(1, how.bins)]
    cuts = [np.unique(df.agg(F.percentile_approx(c, at, 20 * how.bins)).first()[0]) for c in "abc"]
    for j, own in enumerate(cuts):
        assert np.abs([np.mean(x[~np.isnan(x[:, j]), j] <= c) - p for c, p in zip(own, at, strict=True)]).max() < 0.5 / how.bins
    want, trees = plain_boost(x, y, key, how, cuts)
    for size in (B.ROWS_A_TASK, 60):
        monkeypatch.setattr(B, "ROWS_A_TASK", size)
        fit = B.fit_all(df, {"one": B.Fit(("a", "b", "c"), how=how)}, ["id"], chunk=3)["one"]
        assert [{n: (int(t.feature[n]), float(t.cut[n]), bool(t.missing_left[n])) for n in np.flatnonzero(t.feature >= 0).tolist()} for t in fit.trees] == trees
        got = {r.id: r.prediction for r in fit.transform(df).select("id", "prediction").collect()}
        assert np.allclose([got[i] for i in range(240)], want, atol=1e-9)


def test_boosting_side_by_side_and_without_rows(rows):
    """Fits trained together are those trained alone; one without rows predicts nothing; importance adds up."""
    df, *_ = rows
    some = B.Fit(("a", "c"), where=F.col("id") < 100, how=B.Boosting(5, 2, 0.2, rows=0.8))
    both = B.fit_all(df, {"x": some, "none": B.Fit(("a",), where=F.col("id") < 0), "y": B.Fit(("b",), how=B.Boosting(9, 1))}, ["id"])
    alone = B.fit_all(df, {"x": some}, ["id"])["x"]
    assert all(np.allclose(p.value, q.value, atol=1e-12) and (p.feature == q.feature).all() for p, q in zip(both["x"].trees, alone.trees, strict=True))
    assert len(both["y"].trees) == 9 and both["none"].base is None
    assert both["none"].transform(df).where("prediction IS NOT NULL").count() == 0
    assert sum(both["x"].importance().values()) == pytest.approx(1)


def test_passes_send_the_driver_one_sum(spark, rows, monkeypatch):
    """The sums of all tasks are added on executors: what a level collects is one vector, however many tasks there are."""
    from pyspark import RDD

    df, *_ = rows
    monkeypatch.setattr(B, "ROWS_A_TASK", 30)
    monkeypatch.setattr(B, "BLOCKS_A_TASK", 1)
    held, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: held.append(collect(self)) or held[-1])
    fit = B.fit_all(df, {"one": B.Fit(("a", "b", "c"), how=B.Boosting(2, 1, 0.3, bins=16))}, ["id"])["one"]
    sums = [s for s in held if s and isinstance(s[0], tuple) and isinstance(s[0][1], np.ndarray)]
    assert len(fit.trees) == 2 and len(sums) == 2
    widths = sum(len(np.unique(df.agg(F.percentile_approx(c, [k / 16 for k in range(1, 16)], 320)).first()[0])) + 2 for c in "abc")
    assert all(sum(len(v) for _, v in s) == 2 * widths for s in sums)
    parts = [(1, (2, np.array([1e16]))), (1, (0, np.array([1.0]))), (1, (1, np.array([-1e16])))]
    assert [(i, v.tolist()) for i, v in B._added(iter(parts))] == [(1, [1.0 - 1e16 + 1e16])]


def test_leaf_of_a_row_goes_down_the_tree():
    """By columns: the same leaves as from node to node, missing values included."""
    rng = np.random.default_rng(3)
    bins, missing = rng.integers(0, 7, (500, 3)).astype(np.uint8), np.array([6, 6, 6])
    t = B.Tree(np.array([0, 1, -1, 2, 0, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1], np.int32), np.zeros(15), np.array([3, 2, 0, 4, 1] + [0] * 10), np.array([True, False] * 7 + [False]), np.zeros(15), np.zeros(15))
    want = []
    for row in bins:
        node = 0
        while t.feature[node] >= 0:
            b = row[t.feature[node]]
            node = 2 * node + (1 if (t.missing_left[node] if b == 6 else b <= t.place[node]) else 2)
        want.append(node)
    got = t.node_of(np.asfortranarray(bins), missing)
    assert got.tolist() == want and got.dtype == np.uint8


# --- moments -----------------------------------------------------------------------------------------
def test_moments_give_the_models_of_the_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) * [1, 5, 0.1] + [1e6, 0, 3]
    y = x @ [0.5, -1, 4] + rng.normal(size=90)
    g = np.arange(90) % 3
    df = spark.createDataFrame([(int(k), *map(float, r), float(t)) for k, r, t in zip(g, x, y, strict=True)], "g int, a double, b double, c double, y double")
    found = moments.group_moments(df, ["a", "b", "c"], "y", ["g"])
    part = moments.total([found[0,], found[2,]], 4)
    m = g != 1
    z = (x[m] - x[m].mean(0)) / x[m].std(0)
    for alpha in (0.0, 3.0):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[m] - y[m].mean()))
        line = moments.ridge(part, ["a", "b", "c"], alpha)
        assert np.allclose(line.weights * x[m].std(0), w, atol=1e-6)
        assert line.error(found[1,]) == pytest.approx(((y[~m] - line.intercept - x[~m] @ line.weights) ** 2).sum(), rel=1e-5)
    lasso = moments.lasso(part, ["a", "b", "c"], 0.5)
    v = lasso.weights * x[m].std(0)
    pull = z.T @ (y[m] - y[m].mean() - z @ v) / m.sum()
    assert all(abs(p) <= 0.5 + 1e-6 if w == 0 else abs(p - 0.5 * np.sign(w)) < 1e-6 for p, w in zip(pull, v, strict=True))
    assert moments.ridge(moments.Moments.none(4), ["a", "b", "c"]) is None


# --- ridge of a series -------------------------------------------------------------------------------
def plain_ridge(h, years, target):
    h, years = np.array(h, float), np.array(years, float)
    slope = lambda i: np.polyfit(years[:i], h[:i], 1)[0]
    if len(h) < 4:
        return h[-1] if len(h) < 2 else max(0.0, float(np.polyval(np.polyfit(years - years[0], h, 1), target - years[0])))
    row = lambda i: [h[i - 1], h[i - 2], h[:i].mean(), slope(i)]
    x, y = np.array([row(i) for i in range(2, len(h))]), h[2:]
    a = np.vstack([x - x.mean(0), np.eye(4)])
    w = np.linalg.lstsq(a, np.concatenate([y - y.mean(), np.zeros(4)]), rcond=None)[0]
    return max(0.0, float(y.mean() + (np.array(row(len(h))) - x.mean(0)) @ w))


def test_ridge_of_a_series_equals_plain_python(spark):
    rng = np.random.default_rng(9)
    rows = []
    for n in [1, 2, 3, 4, 5, 6, 7, 12, 12, 7, 5]:
        years = sorted(rng.choice(np.arange(1985, 2000), n, replace=False).tolist())
        rows.append((years, [float(v) for v in np.round(rng.gamma(2, 5e4, n), 2)]))
    rows += [([1990, 1991, 1992, 1993, 1994], [7.0] * 5), ([1990, 1991, 1992, 1993], [0.0] * 4)]
    got = spark.createDataFrame(rows, "y array<int>, h array<double>").select("y", "h", series.ridge(F.col("h"), F.col("y"), 2000).alias("p")).collect()
    for r in got:
        want = plain_ridge(r.h, r.y, 2000)
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-6)


# --- contestants -------------------------------------------------------------------------------------
def test_no_fitted_forecast_moves_with_the_future(spark):
    """Values from the forecast year on are changed: no forecast of that year or an earlier one moves."""
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", y, float(v)) for i in range(30) for y, v in zip(range(1993, 2001), np.round(rng.gamma(2, 100, 8), 2), strict=True) if (i + y) % 9]
    frame = lambda rs: spark.createDataFrame(rs, "series_key string, year int, value double")
    later = [(k, y, v * 3 + 7 if y >= 1999 else v) for k, y, v in rows]
    panel, changed = frame(rows), frame(later)
    a, b = ({(r.series_key, r.year): r.predicted for r in methods.boosted(p, (1998, 1999)).collect()} for p in (panel, changed))
    assert a and a == b
    true, moved = ({(r.series_key, r.year): r.predicted for r in methods.boosted(p, (2000,)).collect()} for p in (panel, changed))
    assert true != moved  # 1999 is the past of 2000


def test_tournament_with_ridge_equals_plain_python(spark, sf_dir):
    """Winner, error and forecast of thirty series by a loop over years and methods."""
    from tallyforge.plans import selection
    from tallyforge.sources.panels import fine

    data: dict[str, dict[int, float]] = {}
    for r in fine(spark, sf_dir).collect():
        data.setdefault(r.series_key, {})[r.year] = r.committed
    keys = sorted(data)[:30]
    line = lambda h, t=None: h[-1] if len(h) < 2 else float(np.polyval(np.polyfit(np.arange(len(h)), h, 1), len(h)))
    contestants = {"Mean3": lambda h, ys, t: np.mean(h[-3:]), "Median": lambda h, ys, t: np.median(h), "Naive": lambda h, ys, t: h[-1], "Ridge": plain_ridge, "Trend": lambda h, ys, t: line(h)}
    smape = lambda a, p: 0.0 if abs(a) + abs(p) == 0 else 200 * abs(a - p) / (abs(a) + abs(p))
    got = {r.series_key: r for r in selection.best_with_ridge(spark, sf_dir).collect()}
    seen = 0
    for k in keys:
        errors = {}
        for y in (TARGET - 2, TARGET - 1):
            past = sorted(t for t in data[k] if t < y)
            if y in data[k] and len(past) >= 2:
                for m, f in contestants.items():
                    errors.setdefault(m, []).append(smape(data[k][y], f([data[k][t] for t in past], past, y)))
        past = sorted(t for t in data[k] if t < TARGET)
        if not errors or TARGET not in data[k] or len(past) < 2:
            assert k not in got
            continue
        best = min(errors, key=lambda m: (round(np.mean(errors[m]), 6), m))
        seen += 1
        assert got[k].method == best and got[k].validation_smape == pytest.approx(np.mean(errors[best]), abs=2e-4)
        assert got[k].predicted == pytest.approx(contestants[best]([data[k][t] for t in past], past, TARGET), abs=1)
    assert seen > 10


# --- quantile regression -----------------------------------------------------------------------------
def test_quantile_planes_are_optimal(spark):
    """Against the loss at every vertex of a small table with ties, and with bands of two sizes on a larger one."""
    from itertools import combinations

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 4, (24, 2)).astype(float), rng.integers(0, 6, 24).astype(float)
    full = np.column_stack([np.ones(24), x])
    loss = lambda b, q, a=full, t=y: float(np.maximum(q * (t - a @ b), (q - 1) * (t - a @ b)).sum())
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    corners = [np.linalg.solve(full[list(c)], y[list(c)]) for c in combinations(range(24), 3) if abs(np.linalg.det(full[list(c)])) > 1e-9]
    for q in (0.1, 0.5, 0.95):
        assert loss(quantreg.quantile_fit(df, ["a", "b"], "y", q), q) == pytest.approx(min(loss(b, q) for b in corners), abs=1e-9)
    x = rng.normal(size=(3000, 2)) * [1, 1e4]
    y = x @ [2, 1e-3] + rng.standard_t(3, 3000)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double").persist()
    whole, banded = (quantreg.quantile_fit(df, ["a", "b"], "y", 0.9, band=n) for n in (5000, 200))
    assert np.allclose(whole, banded, rtol=1e-9)
    assert quantreg.optimality(df, ["a", "b"], "y", 0.9, whole).first().holds
    assert not quantreg.optimality(df, ["a", "b"], "y", 0.9, whole + 0.05).first().holds
    df.unpersist()
    assert quantreg.quantile_fit(df.limit(0), ["a", "b"], "y", 0.5) is None


# --- isolation samples and neighbours ----------------------------------------------------------------
def test_isolation_samples_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(700, 2)))] + [(9999, 9.0, 9.0)], "k int, x double, y double")
    one, many = ({r.k: (r.f, r.g) for r in outliers.isolation_forests(df.repartition(n), ["x", "y"], {"f": 60, "g": 20}, sample=64).collect()} for n in (1, 7))
    assert one == many and max(one, key=lambda k: one[k][0]) == 9999
    alone = {r.k: r.isolation for r in outliers.isolation_scores(df, ["x", "y"], trees=20, sample=64).collect()}
    assert all(alone[k] == pytest.approx(one[k][1]) for k in alone)  # the smaller forest is the beginning of the larger


def test_outlier_factor_in_eight_dimensions(spark):
    """Clusters, copies and a cloud in boxes of 40 places at most, against all pairs."""
    rng, k = np.random.default_rng(6), 7
    x = np.round(np.concatenate([rng.normal(size=(150, 8)), rng.normal(size=(150, 8)) * 0.01 + 3, np.zeros((40, 8)), rng.integers(0, 2, (120, 8))]), 3)
    ids = [f"k{i}" for i in range(len(x))]
    d, rank = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.argsort(np.argsort(ids))
    near = [[j for j in np.lexsort((rank, np.round(d[i], 9))) if j != i][:k] for i in range(len(x))]
    kd = [d[i][n].max() for i, n in enumerate(near)]
    lrd = np.array([1 / (np.mean([max(kd[j], d[i][j]) for j in n]) + 1e-10) for i, n in enumerate(near)])
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in zip(ids, x, strict=True)], "k string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {r.k: r.lof for r in outliers.local_outlier_factor(df, "k", names, k, block=40).collect()}
    assert got.keys() == set(ids)
    assert all(got[i] == pytest.approx(lrd[near[j]].mean() / lrd[j], rel=1e-7) for j, i in enumerate(ids))


def test_boxes_hold_at_most_a_block(spark):
    rng = np.random.default_rng(7)
    places = np.unique(np.concatenate([np.round(rng.normal(size=(900, 2)) ** 5, 6), np.column_stack([np.zeros(300), np.arange(300)])]), axis=0)
    df = spark.createDataFrame([([float(a), float(b)], ["x"]) for a, b in places], "x array<double>, ids array<string>")
    boxes = outliers.Boxes(df, 2, 25)
    sizes = [r["count"] for r in boxes.places.groupBy("cell").count().collect()]
    assert max(sizes) <= 25 and sum(sizes) == len(places)


def test_quarterly_rows_are_written_once(spark, sf_dir):
    """Fits and tests read a table, not the line items again and again."""
    from tallyforge.plans import learning

    files = learning.quarterly(spark, sf_dir).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_balls_meet_few_boxes(spark):
    """Boxes cut where the bulk is, not where a few strange places stretch a feature."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=(4000, 2)), rng.normal(size=(4000, 2)) * 1e-3])
    x[:40, 2:] = rng.normal(size=(40, 2)) * 100
    places = spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(x)], "p long, x array<double>, ids array<long>")
    boxes = outliers.Boxes(places, 4, 100)
    met = boxes.visited(places.select("p", "x", F.lit(0.05).alias("radius"))).groupBy("p").count()
    assert met.agg(F.avg("count").alias("m")).first().m < 5


def test_nearest_of_a_tree_equals_all_pairs():
    """More places than leaves hold, copies among them; with and without a radius."""
    rng, k = np.random.default_rng(9), 6
    places = np.unique(np.round(np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(300, 3)) ** 5]), 2), axis=0)
    counts = rng.integers(1, 4, len(places))
    ids = rng.permutation(counts.sum())
    at = np.repeat(places, counts, axis=0)
    x = places[::3]
    d = np.sqrt(((x[:, None] - at[None]) ** 2).sum(2))
    for radius in (np.full(len(x), np.inf), np.full(len(x), 0.2)):
        rows, found, far = outliers._nearest(x, radius, places, ids, counts, k)
        for i in range(len(x)):
            near = [j for j in np.lexsort((ids, np.round(d[i], 9)))[: k + 1] if d[i][j] <= radius[i]]
            assert found[rows == i].tolist() == ids[near].tolist() and np.allclose(far[rows == i], d[i][near], atol=1e-12)


def test_settings_take_fitted_methods_and_drop_their_sql(sf_dir):
    """With Boosting among the methods of the settings, what depends on it has no SQL; all else keeps its own."""
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import json; from tallyforge.catalog import ORACLE_SQL as o; print(json.dumps([n in o for n in ('best_method', 'leaderboard', 'best_with_ridge', 'panel_annual')]))"
    said = []
    for names in ("Naive,Ridge", "Boosting,Naive"):
        env = dict(os.environ, TALLYFORGE_METHODS=names, PYTHONPATH=os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x))
        said.append(json.loads(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd=root, timeout=120, check=True).stdout))
    assert said == [[True] * 4, [False, False, True, True]]
