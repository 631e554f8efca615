"""Null, zero, tie and order rules of the panel functions."""

from __future__ import annotations

import math
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators import learners, outliers, series, windows
from tallyforge.sources import cells, files


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "h array<double>").select(column(F.col("h")).alias("x")).first().x


@pytest.mark.parametrize(
    ("h", "method", "want"),
    [
        ([5.0], "Naive", 5.0),
        ([1.0, 2.0, 3.0], "Trend", 4.0),
        ([1.0, 2.0, 3.0, 4.0], "Mean3", 3.0),
        ([4.0, 1.0, 3.0, 2.0], "Median", 2.5),
        ([1.0, 2.0, 4.0, 8.0], "LogTrend", 16.0),
        ([0.0, 2.0, 4.0], "LogTrend", 6.0),
        ([7.0, 7.0, 7.0, 7.0], "SES", 7.0),
        ([7.0, 7.0, 7.0, 7.0, 7.0], "DampedTrend", 7.0),
        ([10.0, 10.0, 1000.0], "RobustMean", 10.0),
        ([3.0], "Theta", 3.0),
        ([0.0, 1.0], "Weighted", 1 / 1.7),
    ],
)
def test_methods(spark, h, method, want):
    assert one(spark, h, series.METHODS[method]) == pytest.approx(want)


def test_ses_against_plain_python(spark):
    h = [3.0, 9.0, 4.0, 8.0, 5.0]

    def level(x, a):
        out = x[0]
        for v in x[1:]:
            out = a * v + (1 - a) * out
        return out

    best = min(series.ALPHAS, key=lambda a: ((level(h[:-1], a) - h[-1]) ** 2, a))
    assert one(spark, h, series.ses) == pytest.approx(level(h, best))


def test_recursive_appends_its_forecasts(spark):
    got = one(spark, [1.0, 2.0, 3.0], lambda h: series.recursive(h, series.trend, 3))
    assert got == pytest.approx([4.0, 5.0, 6.0])


def test_smart_rules(spark):
    f = lambda h: one(spark, h, lambda c: series.smart(c, series.last(c) * 1.0, F.lit(None).cast("double")))
    assert f([5.0, 0.0, 0.0]) == 0
    assert f([10.0, 10.0, 1.0]) == 1
    assert f([1.0, 1.0, 10.0]) == pytest.approx(7.3)
    assert f([4.0, 4.0, 4.0]) == 4


def test_smape_and_clip_keep_nulls(spark):
    row = spark.sql("SELECT 0D AS a, 0D AS b, CAST(NULL AS DOUBLE) AS n").select(series.smape(F.col("a"), F.col("b")).alias("s"), series.clip(F.col("n"), 0, 1).alias("c")).first()
    assert row.s == 0 and row.c is None


def test_fill_forward_reset(spark):
    df = spark.createDataFrame([(1, "A", None, None), (2, None, "a", None), (3, None, None, "x"), (4, "B", None, None), (5, None, None, "y")], "i int, l1 string, l2 string, l3 string").withColumn("k", F.lit(1))
    got = [(r.l1_full, r.l2_full, r.l3_full) for r in windows.fill_forward_reset(df, ["l1", "l2", "l3"], ["k"], "i").orderBy("i").collect()]
    assert got == [("A", None, None), ("A", "a", None), ("A", "a", "x"), ("B", None, None), ("B", None, "y")]


def test_pair_rows_skips_blank_pairs_and_text_numbers(spark):
    df = spark.createDataFrame([("f", 6, "lab", "12", None), ("f", 7, None, None, "007"), ("f", 8, " ", None, None), ("f", 9, None, None, None)], "file string, row_nr int, h string, k string, b string")
    rows = cells.pair_rows(df, first_row=6, top=["h", "k"], low=["b"], keys=["file"]).collect()
    assert [(r.record, r.h, r.k, r.b) for r in rows] == [(0, "lab", "12", "007")]


def test_scalars(spark):
    df = spark.createDataFrame([("1 234,50", "Élan  d'Été", "12.0"), ("abc", None, " "), (None, "", "007")], "n string, l string, c string")
    got = df.select(X.parse_number(F.col("n")).alias("n"), X.normal_label(F.col("l")).alias("l"), X.normal_code(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1234.5, "elan d ete", "12"), (None, None, None), (None, "", "007")]


@settings(max_examples=25, deadline=None)
@given(st.floats(1e-6, 1e12))
def test_first_digit_property(x):
    assert int(f"{x:e}"[0]) == math.floor(float(f"{x:e}".split("e")[0]))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("001", 1.5), ("002", None)], "code string, v double")
    files.write_delimited(df, str(tmp_path / "t"))
    back = files.read_delimited(spark, str(tmp_path / "t"), "code string, v double")
    assert sorted(map(tuple, back.collect())) == [("001", 1.5), ("002", None)]
    (tmp_path / "bom.csv").write_bytes("﻿Line_Key,Credit_2027\na,1\n".encode())
    raw = spark.read.csv(str(tmp_path / "bom.csv"), header=True)
    assert files.find_column(raw, r"line[_ ]?key|code") == raw.columns[0]
    (tmp_path / "cache.json").write_text('{"a": 0.5, "b": 1}')
    assert sorted(map(tuple, files.read_json_map(spark, str(tmp_path / "cache.json")).collect())) == [("a", 0.5), ("b", 1.0)]
    assert files.first_that_exists(spark, [str(tmp_path / "none"), str(tmp_path / "cache.json")]) == str(tmp_path / "cache.json")
    files.write_sheets({"one two": df}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "one_two")).count() == 2
    assert files.sheet_names(spark, str(tmp_path / "report")) == ["one_two"]
    sheet = files.read_sheet(spark, str(tmp_path / "report"), "one two", "code string, v double, absent date")
    assert sorted(map(tuple, sheet.collect())) == [("001", 1.5, None), ("002", None, None)]
    with pytest.raises(ValueError, match="no sheet"):
        files.read_sheet(spark, str(tmp_path / "report"), "three")
    files.write_delimited(df, str(tmp_path / "marked"), mark=True)
    parts = [p.read_bytes() for p in (tmp_path / "marked").glob("part-*.csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfcode,") for p in parts if p)
    back = files.read_delimited(spark, str(tmp_path / "marked"), "code string, v double")
    assert sorted(map(tuple, back.collect())) == [("001", 1.5), ("002", None)]
    (tmp_path / "many").mkdir()
    for year in (2023, 2024):
        (tmp_path / "many" / f"ledger-{year}.csv").write_text("code,v\n007,1\n")
    (tmp_path / "many" / "other.csv").write_text("code,v\n1,1\n")
    assert sorted(map(tuple, files.read_many(spark, str(tmp_path / "many"), "ledger-*.csv", "code string, v double").collect())) == [("007", 1.0, 2023), ("007", 1.0, 2024)]
    with pytest.raises(ValueError, match="no column"):
        files.find_column(raw, "absent")


def test_labels_follow_compatibility_decomposition(spark):
    texts = ["Élève œuvre", "ﬁn ﬂux", "½ pièce", "ＡＢＣ１２", "n° 5²", "e\u0301te\u0301", "№ 12", "Ǆungla", "", None, "ℂ x", "Ⅳ part", "㎏ 3", "ſtart", "ß"]

    def want(x):
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
        return re.sub("[^a-z0-9]+", " ", plain).strip()

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", X.normal_label(F.col("x")).alias("y"))
    assert [r.y for r in df.orderBy("i").collect()] == [x if x is None else want(x) for x in texts]


def test_lof_marks_the_outlier(spark):
    df = spark.createDataFrame([(str(i), float(i % 7), float(i // 7)) for i in range(49)] + [("far", 60.0, 60.0)], "k string, x double, y double")
    top = outliers.local_outlier_factor(df, "k", ["x", "y"], 5).orderBy(F.desc("lof")).first()
    assert top.k == "far"


def test_isolation_and_mahalanobis_mark_the_outlier(spark):
    df = spark.createDataFrame([(str(i), float(i % 7), float(i // 7)) for i in range(49)] + [("far", 60.0, 60.0)], "k string, x double, y double")
    scored = outliers.isolation_scores(df, ["x", "y"], trees=50, sample=32, seed=1)
    assert scored.orderBy(F.desc("isolation")).first().k == "far"
    assert scored.where("isolation < 0 OR isolation > 1").isEmpty()
    assert outliers.robust_mahalanobis(df, ["x", "y"]).orderBy(F.desc("distance")).first().k == "far"


def test_simulation_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([(str(i), 0.2, 0.4, 0.6, 0.9) for i in range(20)], "series_key string, t1 double, t2 double, t3 double, t4 double")
    rows = learners.simulate_lines(df, seed=3).collect()
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r.series_key, r.quarter)):
        by.setdefault(r.series_key, []).append(r.taux)
    assert all(v == sorted(v) and 0 <= v[0] and v[-1] <= 1 for v in by.values())


def test_no_training_year_reaches_the_target(spark, sf_dir):
    from tallyforge.plans.selection import VALID, walk

    rows = walk(spark, sf_dir).select("year", F.size("h").alias("n")).distinct().collect()
    assert {r.year for r in rows} <= set(VALID)


def test_streaming_rates(spark, sf_dir):
    from tallyforge.streaming.rates import event_rates, run_once

    got = run_once(spark, sf_dir, event_rates)
    assert got and all(r.n > 0 for r in got)


def test_snapshots(spark, tmp_path):
    from tallyforge.sources import snapshots as N

    folder = str(tmp_path / "state")
    assert N.read_snapshot(spark, folder) is None
    first = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1)], "k string, v double")
    second = spark.createDataFrame([("a", 0.6), ("b", 0.52), ("d", 0.9)], "k string, v double")
    assert [N.write_snapshot(df, folder) for df in (first, second)] == [1, 2]
    diff = N.changes(N.read_snapshot(spark, folder), N.read_snapshot(spark, folder, 1), "k", "v", 0.05).collect()
    assert [(r.k, r.direction) for r in diff] == [("a", "up")]
    for df in (first, second):
        N.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_command_line(spark, sf_dir, tmp_path):
    from tallyforge.__main__ import main

    assert main([sf_dir, str(tmp_path), "rollup_levels"]) == 0
    assert spark.read.parquet(str(tmp_path / "rollup_levels")).count() > 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=900)] + [("b", float(x)) for x in rng.integers(0, 5, 300)] + [("c", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    levels = {"q1": 0.1, "q5": 0.5, "q9": 0.9, "top": 1.0}
    by = {r.g: r for r in windows.quantiles(df, "v", levels, ("g",)).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert [by[g][k] for k in levels] == pytest.approx([np.quantile(own, p) for p in levels.values()])
    every = windows.quantiles(df, "v", levels).first()
    assert [every[k] for k in levels] == pytest.approx([np.quantile([v for _, v in rows if v is not None], p) for p in levels.values()])
    assert windows.quantiles(df.where("v IS NULL"), "v", {"q": 0.5}).first().q is None


def test_walk_forward_has_all_folds_and_models(spark, sf_dir):
    """Every complete year with an earlier one, by all estimators and baselines."""
    from tallyforge.plans import learning

    years = sorted(r.year for r in learning.quarterly(spark, sf_dir).select("year").distinct().collect() if r.year <= learning.TARGET)
    got = {(r.test_year, r.model) for r in learning.walk_forward_cv(spark, sf_dir).select("test_year", "model").distinct().collect()}
    assert len(years) > 3
    assert got == {(y, m) for y in years[1:] for m in (*learners.ESTIMATORS, "seasonal", "mean")}


def test_another_target_year_horizon_and_methods(tmp_path, sf_dir):
    """The command line's settings reach queries and SQL alike, in a process of their own."""
    import json
    import subprocess
    import sys

    code = """
import json, sys
sys.path[:0] = ["tests"]
from oracle import assert_same
from tallyforge.catalog import ORACLE_SQL, QUERIES
from tallyforge.session import local_session
spark = local_session(4, 4, "2g")
for name in ("best_method", "recursive_h", "adaptive_cv", "rule_counts"):
    assert_same(QUERIES[name](spark, sys.argv[1]), ORACLE_SQL[name], sys.argv[1])
steps = QUERIES["recursive_h"](spark, sys.argv[1]).agg({"step": "max"}).first()[0]
methods = sorted(r.method for r in QUERIES["leaderboard"](spark, sys.argv[1]).collect())
print(json.dumps([steps, methods]))
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, TALLYFORGE_TARGET_YEAR="1999", TALLYFORGE_HORIZON="2", TALLYFORGE_METHODS="SES,Naive,Trend", PYTHONPATH=os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x))
    done = subprocess.run([sys.executable, "-c", code, sf_dir], capture_output=True, text=True, env=env, cwd=root, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1]) == [2, ["Naive", "SES", "Trend"]]
    run = subprocess.run([sys.executable, "-m", "tallyforge", sf_dir, str(tmp_path), "recursive_h", "--target-year", "1999", "--horizon", "1"], capture_output=True, text=True, env=env, cwd=root, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    import pyarrow.parquet as pq

    assert set(pq.read_table(tmp_path / "recursive_h")["step"].to_pylist()) == {1}


def test_bound_values_are_those_of_plain_expressions(spark):
    """Forecasters that run all parameters in one pass, against a loop over them."""
    from tallyforge.operators import series as S

    rows = [(i, [float((7 * i + 13 * j * j) % 50) for j in range(n)]) for i, n in enumerate((1, 2, 3, 4, 5, 9))]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, h array<double>").select("i", S.ses(F.col("h")).alias("s"), S.damped(F.col("h")).alias("d"), S.robust_mean(F.col("h")).alias("r"), S.median(F.col("h")).alias("m")).collect()}

    def level(h, a):
        v = h[0]
        for x in h[1:]:
            v = a * x + (1 - a) * v
        return v

    def holt(h, a, b, p):
        v, t = h[0], h[1] - h[0]
        for x in h[1:]:
            n = a * x + (1 - a) * (v + p * t)
            v, t = n, b * (n - v) + (1 - b) * p * t
        return v + p * t

    for i, h in rows:
        if len(h) >= 3:
            a = min(S.ALPHAS, key=lambda a: ((level(h[:-1], a) - h[-1]) ** 2, a))
            assert abs(got[i].s - level(h, a)) < 1e-9
        if len(h) > 3:
            x = min(enumerate(S.DAMPED), key=lambda q: ((holt(h[:-1], *q[1]) - h[-1]) ** 2, q[0]))[1]
            assert abs(got[i].d - holt(h, *x)) < 1e-9
        s = sorted(h)
        assert got[i].m == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def test_seven_signals(spark, sf_dir):
    """Flags, votes and agreement follow from the signals by their definition."""
    from tallyforge.plans import anomalies as A

    rows = [r.asDict() for r in A.seven_signals(spark, sf_dir).collect()]
    assert rows and all(r[s] is not None for r in rows for s in A.SEVEN)

    def quantile(v, p):
        v, at = sorted(v), p * (len(v) - 1)
        lo = math.floor(at)
        return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)

    flags = {}
    for s, p in A.SEVEN.items():
        cut = quantile([r[s] for r in rows if s != "forecast" or r[s] > 0], p) if p else 2
        flags[s] = {(r["series_key"], r["year"]) for r in rows if r[s] >= cut - 1e-12}
    got = {(r.series_key, r.year): r for r in A.seven_signal_score(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert all(got[k].n_signals == sum(k in f for f in flags.values()) for k in got)
    ends = {s: (min(r[s] for r in rows), max(r[s] for r in rows)) for s in A.SEVEN}
    for r in rows:
        unit = [(r[s] - lo) / (hi - lo) if hi - lo >= 1e-12 else 0.0 for s, (lo, hi) in ends.items()]
        assert abs(got[r["series_key"], r["year"]].score - sum(unit) / 7) < 2e-6
    pairs = {(r.a, r.b): r.jaccard for r in A.seven_signal_agreement(spark, sf_dir).collect()}
    assert len(pairs) == 49
    for (a, b), j in pairs.items():
        either = flags[a] | flags[b]
        assert abs(j - (len(flags[a] & flags[b]) / len(either) if either else 0.0)) < 6e-4


def test_outlier_factor_equals_brute_force(spark):
    """Many equal places, a grid full of ties and a cloud; in one cell and in many."""
    import numpy as np

    rng, k = np.random.default_rng(1), 5
    pts = np.round(np.concatenate([rng.normal(size=(200, 2)), np.zeros((200, 2)), rng.integers(0, 6, (200, 2))]), 3)
    ids = [f"k{i}" for i in range(len(pts))]
    d, rank = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)), np.argsort(np.argsort(ids))
    near = [[j for j in np.lexsort((rank, np.round(d[i], 9))) if j != i][:k] for i in range(len(pts))]
    kd = [d[i][n].max() for i, n in enumerate(near)]
    lrd = np.array([1 / (np.mean([max(kd[j], d[i][j]) for j in n]) + 1e-10) for i, n in enumerate(near)])
    want = {ids[i]: lrd[n].mean() / lrd[i] for i, n in enumerate(near)}
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in zip(ids, pts, strict=True)], "k string, x double, y double").repartition(3)
    for block in (4096, 60):
        got = {r.k: r.lof for r in outliers.local_outlier_factor(df, "k", ["x", "y"], k, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], rel_tol=1e-7) for i in ids)
    one = {r.k: r.lof for r in outliers.local_outlier_factor(df.limit(1), "k", ["x"], k).collect()}
    assert one == {}
