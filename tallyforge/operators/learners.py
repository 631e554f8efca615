"""Estimators over DataFrames: MLlib pipelines, linear models from moments, boosted ensembles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written_once
from . import moments as M
from .boosting import Boosting, Fit, fit_all

ESTIMATORS = ("linear", "ridge", "lasso", "forest", "boosting", "leafwise")
BASELINES = ("seasonal", "mean")
#: Penalties of the folds' ridge and lasso on standardised features (fixed values).
ALPHAS = {"linear": 0.0, "ridge": 1.0, "lasso": 0.01}
#: Boosted ensembles of the reports (fixed values). "leafwise" grows by the best leaf; its share of rows is 1, as no bagging frequency is set there.
BOOSTED = {
    "selection": Boosting(rounds=200, depth=2, rate=0.05, rows=0.8, l1=0.1),
    "leafwise": Boosting(rounds=200, depth=3, rate=0.05, columns=0.8, l2=0.0, least=2, leaves=15),
    "alerts": Boosting(rounds=200, depth=2, rate=0.03, rows=0.7, columns=0.8, l1=0.5),
    "backtest": Boosting(rounds=300, depth=3, rate=0.05, rows=0.8, l1=0.1),
    "pooled": Boosting(rounds=300, depth=3, rate=0.05, rows=0.9),
}


def estimator(name: str, features: list[str], label: str = "label", seed: int = 42, trees: int = 200) -> Pipeline:
    """Assembled, scaled features and one of: linear, ridge, lasso, forest (of so many trees). Boosted ensembles are in operators/boosting.py."""
    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    common = {"featuresCol": "features", "labelCol": label}
    if name in ("linear", "ridge", "lasso"):
        steps.append(LinearRegression(regParam={"linear": 0.0, "ridge": 1e-3, "lasso": 1e-3}[name], elasticNetParam=float(name == "lasso"), standardization=False, **common))
    elif name == "forest":
        steps.append(RandomForestRegressor(numTrees=trees, maxDepth=3, minInstancesPerNode=2, seed=seed, **common))
    else:
        raise ValueError(f"no estimator is called {name}")
    return Pipeline(stages=steps)


def _baseline(name: str, past: DataFrame, now: DataFrame) -> DataFrame:
    """now with prediction: the series' last label before (seasonal) or the mean of its category's labels (mean); the mean of all past labels where there is none."""
    key = {"seasonal": "series_key", "mean": "category"}[name]
    known = past.groupBy(key).agg((F.max_by("label", "year") if name == "seasonal" else F.avg("label")).alias("known"))
    rest = past.agg(F.avg("label").alias("rest"))
    return now.join(known, key, "left").crossJoin(F.broadcast(rest)).withColumn("prediction", F.coalesce("known", "rest"))


def fold_lines(by_year: dict[int, M.Moments], features: list[str], name: str, year: int) -> M.Line | None:
    """The linear model of a fold, from the moments of its earlier years."""
    past = M.total([m for y, m in by_year.items() if y < year], len(features) + 1)
    return M.lasso(past, features, ALPHAS[name]) if name == "lasso" else M.ridge(past, features, ALPHAS[name])


def errors_by_category(df: DataFrame, year: int, model: str) -> DataFrame:
    """test_year, category, model, rmse, mae, mape of label and prediction; mape leaves zero labels out."""
    e = F.abs(F.col("label") - F.col("prediction"))
    part = df.groupBy("category").agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("mae"), F.round(F.avg(F.when(F.col("label") != 0, e / F.abs("label"))) * 100, 4).alias("mape"))
    return part.select(F.lit(year).alias("test_year"), "category", F.lit(model).alias("model"), "rmse", "mae", "mape")


def walk_forward(df: DataFrame, features: list[str], names: Iterable[str], years: Iterable[int] | None = None, trees: int = 200) -> DataFrame:
    """test_year, category, model, rmse, mae, mape: each year is predicted by models of strictly earlier years.

    Without years, all of df that have an earlier one. names: of ESTIMATORS and BASELINES. The rows are written once. Linear models of all folds come from the moments of
    one scan, boosted ensembles of all folds are trained side by side; only forests are fitted fold by fold.
    """
    df, names = written_once(df, "folds"), list(names)
    moments = {y: m for (y,), m in M.group_moments(df, features, "label", ["year"]).items()}
    years = sorted(moments)[1:] if years is None else list(years)
    sets = {"boosting": BOOSTED["selection"], "leafwise": BOOSTED["leafwise"]}
    fits = {(n, y): Fit(tuple(features), "label", F.col("year") < y, sets[n]) for n in names if n in sets for y in years}
    ensembles = fit_all(df, {f"{n}:{y}": f for (n, y), f in fits.items()}, ["series_key", "year"]) if fits else {}
    out = []
    for year in years:
        past, now = df.where(F.col("year") < year), df.where(F.col("year") == year)
        for name in names:
            if name in BASELINES:
                p = _baseline(name, past, now)
            elif name in ALPHAS:
                line = fold_lines(moments, features, name, year)
                p = now.withColumn("prediction", line.column() if line else F.lit(None).cast("double"))
            elif name in sets:
                p = ensembles[f"{name}:{year}"].transform(now)
            else:
                p = estimator(name, features, trees=trees).fit(past).transform(now)
            out.append(errors_by_category(p, year, name))
    if not out:
        return df.sparkSession.createDataFrame([], "test_year int, category string, model string, rmse double, mae double, mape double")
    return reduce(DataFrame.unionByName, out)


def fold_of(parts: int, *key: str) -> Column:
    """Fold number from a digest of the key: the same in every run, and in SQL."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("long") % parts).cast("int")


PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


def ridge_by_cv(df: DataFrame, features: list[str], key: list[str], penalties: tuple[float, ...] = PENALTIES, parts: int = 3) -> tuple[M.Line | None, float]:
    """Ridge over standardised features whose penalty cross-validation picks, and that penalty, from the moments of one scan; folds by a digest of the key."""
    found = M.group_moments(df.withColumn("_fold", fold_of(parts, *key)), features, "label", ["_fold"])
    return M.cross_validated_ridge([found.get((i,), M.Moments.none(len(features) + 1)) for i in range(parts)], features, list(penalties))


def permuted_error(df: DataFrame, target: int, seed: int, digits: int = 2) -> DataFrame:
    """kind, smape: error of the last value as predictor, on the true panel and after values were exchanged within each year.

    Values change places within groups of series (`digits` hexadecimal digits of a digest of the key: 256 groups a year), so no task orders a whole year. The
    order is that of a digest of series, year and seed: the same in every run.
    """
    digest = lambda *c: F.md5(F.concat_ws(":", *c))
    grouped = df.withColumn("g", F.substring(digest("series_key"), 1, digits))
    place = lambda *o: F.row_number().over(W.partitionBy("year", "g").orderBy(*o))
    a = grouped.withColumn("i", place("series_key"))
    b = grouped.withColumn("i", place(digest("series_key", "year", F.lit(seed)), "series_key")).select("year", "g", "i", F.col("committed").alias("other"))
    both = a.join(b, ["year", "g", "i"])
    w = W.partitionBy("series_key").orderBy("year")
    err = lambda v, p: F.when(F.abs(v) + F.abs(p) == 0, F.lit(0.0)).otherwise(200 * F.abs(v - p) / (F.abs(v) + F.abs(p)))
    e = both.withColumns({"t": F.lag("committed").over(w), "s": F.lag("other").over(w)}).where(F.col("year") == target)
    one = e.agg(F.round(F.avg(err(F.col("committed"), F.col("t"))), 4).alias("true"), F.round(F.avg(err(F.col("other"), F.col("s"))), 4).alias("permuted"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("smape")) for k in ("true", "permuted")])).alias("r")).select("r.*")


def simulate_lines(df: DataFrame, seed: int) -> DataFrame:
    """series_key, quarter, taux: seeded noise around each quarter's rate, clipped, scaled to the aggregate and made monotone."""
    rows = df.select("series_key", F.explode(F.array(*[F.struct(F.lit(q).alias("quarter"), F.col(f"t{q}").alias("base")) for q in (1, 2, 3, 4)])).alias("r")).select("series_key", "r.*").where("base IS NOT NULL")
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws(":", "series_key", "quarter", F.lit(seed + k))), 1, 8), 16, 10).cast("double") + 0.5) / (1 << 32)
    noise = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * np.pi * u(2))  # a digest as source, so the draw is the same in every run and partition
    noisy = rows.withColumn("taux", F.least(F.greatest(F.col("base") + 0.05 * noise, F.lit(0.0)), F.lit(1.0)))
    scale = noisy.groupBy("quarter").agg((F.avg("base") / F.avg("taux")).alias("k"))
    scaled = noisy.join(F.broadcast(scale), "quarter").withColumn("taux", F.least(F.col("taux") * F.col("k"), F.lit(1.0)))
    run = F.max("taux").over(W.partitionBy("series_key").orderBy("quarter").rowsBetween(W.unboundedPreceding, 0))
    return scaled.select("series_key", "quarter", F.round(run, 6).alias("taux"))
