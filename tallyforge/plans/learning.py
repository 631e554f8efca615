"""Fitted models: linear ones against SQL, ensembles against plain versions and by properties, as no SQL gives the same fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import learners as L
from ..operators import moments as M
from ..operators import quantreg as Q
from ..operators import series as S
from ..operators.boosting import Fit, fit_all
from ..operators.windows import quantiles
from ..sources.panels import TARGET, fine
from ..sources.shared import written_once
from .base_sql import FINE, QUARTERS, with_
from .features import WIDE_SQL, pooled, wide
from .registry import query


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with features t1, t2, prev (year-end of the year before), size and label t4, all known. Written once, as each fit and each test reads them again."""
    w = W.partitionBy("series_key").orderBy("year")
    df = wide(spark, sf_dir).withColumns({"prev": F.lag("t4").over(w), "size": F.ln("annual")})
    return written_once(df.dropna(subset=["t1", "t2", "t3", "t4", "prev"]).withColumn("label", F.col("t4")), "quarterly")


FEATURES = ["t1", "t2", "prev", "size"]


def linear_sql(name: str, rows: str, test: str, features: list[str], label: str, penalty: float = 0.0, scale: bool | str = True) -> str:
    """Common tables that end with `name`: all columns of `test` and p, the prediction of a linear fit on `rows`.

    Features are scaled by mean and deviation and made orthogonal one after another, each step with its share of the label taken out. A penalty
    stands in rows of its own, one a feature. Without scale features are only centred, and the penalty counts against the sum of squares; so it
    does with scale "population", where features are divided by their population deviations.
    """
    n, whole = len(features), scale is True
    stats = ", ".join(f"avg({f}) AS m{i}, {'stddev_samp' if whole else 'stddev_pop'}({f}) AS s{i}" for i, f in enumerate(features))
    scaled = ", ".join(f"({f} - m{i}){f' / s{i}' if scale else ''} AS c{i}" for i, f in enumerate(features))
    out = [f"{name}_m AS (SELECT count(*) AS n, avg({label}) AS my, stddev_pop({label}) AS sy, {stats} FROM {rows})", f"{name}_t AS (SELECT row_number() OVER () AS rid, * FROM {test})"]
    parts = [f"SELECT 0 AS rid, 1 AS learn, {scaled}, {label} - my AS y, 0.0 AS p FROM {rows}, {name}_m", f"SELECT rid, 0, {scaled}, 0.0, my FROM {name}_t, {name}_m"]
    if penalty:
        parts += [f"SELECT 0, 1, {', '.join(f'sqrt({f"n * {penalty} / sy" if whole else penalty})' if i == j else '0.0' for j in range(n))}, 0.0, 0.0 FROM {name}_m" for i in range(n)]
    out.append(f"{name}_0 AS ({' UNION ALL '.join(parts)})")
    for i in range(n):
        later = [f"c{j}" for j in range(i + 1, n)] + ["y"]
        out.append(f"{name}_g{i} AS (SELECT {', '.join(f'sum(c{i} * {c}) / sum(c{i} * c{i}) AS k_{c}' for c in later)} FROM {name}_{i} WHERE learn = 1)")
        out.append(f"{name}_{i + 1} AS (SELECT rid, learn, {', '.join(f'{c} - k_{c} * c{i} AS {c}' for c in later)}, p + k_y * c{i} AS p FROM {name}_{i}, {name}_g{i})")
    return ",\n".join([*out, f"{name} AS (SELECT t.*, p FROM {name}_t t JOIN {name}_{n} USING (rid) WHERE learn = 0)"])


QUARTERLY_SQL = f"""qrows AS (SELECT * FROM (SELECT *, lag(t4) OVER (PARTITION BY series_key ORDER BY year) AS prev, ln(annual) AS size FROM wide)
  WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL AND t4 IS NOT NULL AND prev IS NOT NULL),
train AS (SELECT * FROM qrows WHERE year < {TARGET}), test AS (SELECT * FROM qrows WHERE year = {TARGET})"""
_PENALTY = {"linear": 0.0, "ridge": 1e-3}


def _fitted(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = quarterly(spark, sf_dir)
        train, test = df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET)
        if name in _BOOSTED:
            out = fit_all(train, {name: Fit(tuple(FEATURES), how=_BOOSTED[name])}, ["series_key", "year"])[name].transform(test)
        else:
            out = L.estimator(name, FEATURES).fit(train).transform(test)
        return out.select("series_key", F.round("label", 6).alias("actual"), F.round("prediction", 6).alias("predicted"))

    run.__doc__ = f"Year-end rate by {name}, fitted on earlier years."
    sql = with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL, linear_sql("fit", "train", "test", FEATURES, "t4", _PENALTY[name])) + "SELECT series_key, round(t4, 6) AS actual, round(p, 6) AS predicted FROM fit" if name in _PENALTY else None
    query(sql, f"model_{name}")(run)


_BOOSTED = {"boosting": L.BOOSTED["selection"], "leafwise": L.BOOSTED["leafwise"]}
for _n in L.ESTIMATORS:
    _fitted(_n)


@query()
def walk_forward_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and MAPE of all models and baselines by fold: each complete year with an earlier one is predicted from strictly earlier ones."""
    return L.walk_forward(quarterly(spark, sf_dir).where(F.col("year") <= TARGET), FEATURES, (*L.ESTIMATORS, *L.BASELINES))


#: Folds of the linear part: four test years, as in the reports.
FOLDS = tuple(range(TARGET - 3, TARGET + 1))


def _folds_sql() -> str:
    parts, rows = [], []
    for y in FOLDS:
        parts += [f"past{y} AS (SELECT * FROM qrows WHERE year < {y})", f"now{y} AS (SELECT * FROM qrows WHERE year = {y})"]
        for name in ("linear", "ridge"):
            parts.append(linear_sql(f"{name}{y}", f"past{y}", f"now{y}", FEATURES, "t4", L.ALPHAS[name], scale="population"))
            rows.append(f"SELECT {y} AS test_year, category, '{name}' AS model, t4, p FROM {name}{y}")
        rest = f"(SELECT avg(t4) FROM past{y})"
        rows.append(f"SELECT {y}, n.category, 'seasonal', n.t4, coalesce(k.v, {rest}) FROM now{y} n LEFT JOIN (SELECT series_key, arg_max(t4, year) AS v FROM past{y} GROUP BY 1) k USING (series_key)")
        rows.append(f"SELECT {y}, n.category, 'mean', n.t4, coalesce(k.v, {rest}) FROM now{y} n LEFT JOIN (SELECT category, avg(t4) AS v FROM past{y} GROUP BY 1) k USING (category)")
    return with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL, *parts, f"every AS ({' UNION ALL '.join(rows)})") + """SELECT test_year, category, model, round(sqrt(avg((t4 - p) * (t4 - p))), 6) AS rmse, round(avg(abs(t4 - p)), 6) AS mae,
  round(avg(CASE WHEN t4 <> 0 THEN abs(t4 - p) / abs(t4) END) * 100, 4) AS mape FROM every GROUP BY 1, 2, 3"""


@query(_folds_sql())
def walk_forward_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear part of the folds over the last four years: least squares, ridge and both baselines. All folds' models come from the moments of one scan."""
    return L.walk_forward(quarterly(spark, sf_dir).where(F.col("year") <= TARGET), FEATURES, ("linear", "ridge", *L.BASELINES), FOLDS)


def _ridge_cv_sql(parts: int = 3) -> str:
    """Every penalty and fold by its own chain of common tables."""
    ctes = [f"folded AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', series_key, year)), 1, 8) AS BIGINT) % {parts} AS fold FROM train)"]
    scores = []
    for k in range(parts):
        ctes += [f"in{k} AS (SELECT * FROM folded WHERE fold <> {k})", f"out{k} AS (SELECT * FROM folded WHERE fold = {k})"]
    for i, p in enumerate(L.PENALTIES):
        for k in range(parts):
            ctes.append(linear_sql(f"cv{i}_{k}", f"in{k}", f"out{k}", FEATURES, "t4", p, scale="population"))
            scores.append(f"SELECT {i} AS i, 1 - sum((t4 - p) * (t4 - p)) / (var_pop(t4) * count(*)) AS r2 FROM cv{i}_{k}")
        ctes.append(linear_sql(f"all{i}", "train", "test", FEATURES, "t4", p, scale="population"))
    ctes.append(f"best AS (SELECT i FROM (SELECT i, row_number() OVER (ORDER BY round(avg(r2), 9) DESC, i) AS rn FROM ({' UNION ALL '.join(scores)}) GROUP BY i) WHERE rn = 1)")
    fits = " UNION ALL ".join(f"SELECT {i} AS i, CAST({p} AS DOUBLE) AS penalty, series_key, p FROM all{i}" for i, p in enumerate(L.PENALTIES))
    return with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL, *ctes) + f"SELECT series_key, penalty, round(greatest(p, 0), 6) AS predicted FROM ({fits}) JOIN best USING (i)"


@query(_ridge_cv_sql())
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge whose penalty three-fold cross-validation picks; all folds and penalties from the moments of one scan."""
    df = quarterly(spark, sf_dir)
    line, penalty = L.ridge_by_cv(df.where(F.col("year") < TARGET), FEATURES, ["series_key", "year"])
    p = F.greatest(line.column(), F.lit(0.0)) if line else F.lit(None).cast("double")
    return df.where(F.col("year") == TARGET).select("series_key", F.lit(float(penalty)).alias("penalty"), F.round(p, 6).alias("predicted"))


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each feature in a forest."""
    model = L.estimator("forest", FEATURES).fit(quarterly(spark, sf_dir).where(F.col("year") < TARGET))
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(round(v, 6))) for f, v in zip(FEATURES, values, strict=True)], "feature string, importance double")


POOLED = ("line", "year", "lag1", "lag2", "mean_past", "slope")


@query()
def forecast_pooled_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boosted model over all series, on a number of the series, the year, lags, mean and slope of strictly earlier years."""
    df = pooled(spark, sf_dir).select("series_key", "year", F.crc32("series_key").cast("double").alias("line"), F.col("committed").alias("label"), *POOLED[2:])
    model = fit_all(df, {"boosting": Fit(POOLED, where=F.col("year") < TARGET, how=L.BOOSTED["pooled"])}, ["series_key", "year"])["boosting"]
    return model.transform(df.where(F.col("year") == TARGET)).select("series_key", F.round(F.greatest("prediction", F.lit(0.0)), 2).alias("predicted"))


_SLOPE = "(list_dot_product(CAST(list_transform({y}, lambda t: t - list_avg({y})) AS DOUBLE[]), {v}) / list_dot_product(CAST(list_transform({y}, lambda t: t - list_avg({y})) AS DOUBLE[]), CAST(list_transform({y}, lambda t: t - list_avg({y})) AS DOUBLE[])))"


def ridge_sql(name: str, source: str, target: str) -> str:
    """Common tables that end with `name`: all columns of `source` (with h and ys) and p, the series' own ridge, made orthogonal step by step like linear_sql but in lists."""
    sub = lambda v, y, i: f"[{v}[{i}], {v}[{i} - 1], list_avg({v}[1:{i}]), {_SLOPE.format(v=f'{v}[1:{i}]', y=f'{y}[1:{i}]')}]"
    centre = ", ".join(f"list_avg(list_transform(z[1:m], lambda r: r[{j + 1}])) AS a{j}" for j in range(4))
    cells = ", ".join(f"list_concat(list_transform(z[1:m], lambda r: r[{j + 1}] - a{j}), [{', '.join('1.0::DOUBLE' if k == j else '0.0::DOUBLE' for k in range(4))}], [z[m + 1][{j + 1}] - a{j}]) AS c{j}" for j in range(4))
    out = [
        f"{name}_z AS (SELECT *, len(h) - 2 AS m, list_transform(range(2, len(h) + 1), lambda i: {sub('h', 'ys', 'i')}) AS z FROM {source} WHERE len(h) >= 4)",
        f"{name}_a AS (SELECT *, {centre}, list_avg(h[3:len(h)]) AS my FROM {name}_z)",
        f"{name}_0 AS (SELECT *, {cells}, list_concat(list_transform(h[3:len(h)], lambda v: v - my), [0.0::DOUBLE, 0, 0, 0, 0]) AS y, my AS p FROM {name}_a)",
    ]
    for i in range(4):
        later = [f"c{j}" for j in range(i + 1, 4)] + ["y"]
        k = lambda c, i=i: f"coalesce(list_dot_product(c{i}[1:m + 4], {c}[1:m + 4]) / nullif(list_dot_product(c{i}[1:m + 4], c{i}[1:m + 4]), 0), 0)"
        out.append(f"{name}_k{i} AS (SELECT *, {', '.join(f'{k(c)} AS k_{c}' for c in later)} FROM {name}_{i})")
        moved = ", ".join(f"list_transform(range(1, m + 6), lambda r: {c}[r] - k_{c} * c{i}[r]) AS {c}" for c in later)
        out.append(f"{name}_{i + 1} AS (SELECT * EXCLUDE ({', '.join(['p', *later, *[f'k_{c}' for c in later]])}), {moved}, p + k_y * c{i}[m + 5] AS p FROM {name}_k{i})")
    line = f"list_avg(h) + coalesce({_SLOPE.format(v='h', y='ys')}, 0) * ({target} - list_avg(ys))"
    keep = "series_key"
    out.append(f"{name} AS (SELECT s.*, CASE WHEN len(h) < 2 THEN h[1] WHEN len(h) < 4 THEN greatest({line}, 0) ELSE greatest(q.p, 0) END AS p FROM {source} s LEFT JOIN (SELECT {keep}, year AS at_year, p FROM {name}_4) q ON q.{keep} = s.{keep} AND q.at_year = s.year)")
    return ",\n".join(out)


@query(with_(FINE, f"series AS (SELECT series_key, {TARGET} AS year, list(committed ORDER BY year) AS h, list(year ORDER BY year) AS ys FROM fine WHERE year < {TARGET} GROUP BY 1)", ridge_sql("own", "series", str(TARGET))) + "SELECT series_key, round(p, 0) AS predicted FROM own")
def forecast_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge of each series on its own lags, mean and slope; a line where there is too little history. An expression over the collapsed history."""
    h = S.collapse(fine(spark, sf_dir, until=TARGET), ["series_key"], "year", "committed")
    return h.select("series_key", F.round(S.ridge(F.col("committeds"), F.col("years"), TARGET), 0).alias("predicted"))


QUANTILES = (0.05, 0.5, 0.95)


@query()
def quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantile regression at 5, 50 and 95 percent; crossed bounds are swapped."""
    df = quarterly(spark, sf_dir)
    out = Q.quantile_regression(df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET), FEATURES, "label", QUANTILES)
    return out.select("series_key", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")], F.col("label").between(F.col("lo"), F.col("hi")).alias("covered"))


@query(with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL) + f"SELECT CAST(q AS DOUBLE) AS quantile, (SELECT count(*) FROM train) AS n, true AS holds FROM (SELECT unnest({list(QUANTILES)}) AS q)")
def quantile_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each fitted plane is an optimum: signs of the residuals against the subgradients of the rows on it."""
    train = quarterly(spark, sf_dir).where(F.col("year") < TARGET)
    parts = [Q.optimality(train, FEATURES, "label", q, Q.quantile_fit(train, FEATURES, "label", q)) for q in QUANTILES]
    return reduce(DataFrame.unionByName, parts)


_STAGED_SQL = ",\n".join([linear_sql("direct", "train", "test", FEATURES, "t4"), linear_sql("third", "train", "test", FEATURES, "t3"), "moved AS (SELECT series_key, t2, p AS t3, prev FROM third)", linear_sql("rolled", "train", "moved", ["t2", "t3", "prev"], "t4")])


@query(with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL, _STAGED_SQL) + "SELECT d.series_key, round(d.t4, 6) AS actual, round(d.p, 6) AS direct, round(r.p, 6) AS rolling FROM direct d JOIN rolled r USING (series_key)")
def two_stage_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct forecast of the year's end from its middle, and a rolling one over the third quarter: trained on actual, applied to predicted third quarters."""
    df = quarterly(spark, sf_dir)
    train, test = df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET)
    direct = L.estimator("linear", FEATURES).fit(train)
    third = L.estimator("linear", FEATURES).fit(train.withColumn("label", F.col("t3")))
    last = L.estimator("linear", ["t2", "t3", "prev"]).fit(train)
    staged = third.transform(test).withColumn("t3", F.col("prediction")).drop("prediction", "features", "raw")
    rolling = last.transform(staged).select("series_key", F.col("prediction").alias("rolling"))
    return direct.transform(test).select("series_key", F.round("label", 6).alias("actual"), F.round("prediction", 6).alias("direct")).join(rolling, "series_key").select("series_key", "actual", "direct", F.round("rolling", 6).alias("rolling"))


@query()
def specialised_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of its own for each kind of category: boosting, lasso, or the historical mean."""
    df = quarterly(spark, sf_dir)
    kind = F.when(F.col("category") == "AFRICA", "boosting").when(F.col("category") == "ASIA", "lasso").otherwise("mean")
    df = written_once(df.withColumn("kind", kind), "dispatch")
    past, now = df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET)
    boosted = fit_all(past, {"boosting": Fit(tuple(FEATURES), where=F.col("kind") == "boosting", how=L.BOOSTED["backtest"])}, ["series_key", "year"])["boosting"]
    moments = M.group_moments(past, FEATURES, "label", ["kind"])
    line = M.lasso(moments.get(("lasso",), M.Moments.none(len(FEATURES) + 1)), FEATURES, L.ALPHAS["lasso"])
    mean = past.where("kind = 'mean'").groupBy("series_key").agg(F.avg("label").alias("p"))
    out = boosted.transform(now.where("kind = 'boosting'"), "p").select("series_key", "kind", "p").where("p IS NOT NULL")
    out = out.unionByName(now.where("kind = 'mean'").select("series_key", "kind").join(mean, "series_key").select("series_key", "kind", "p"))
    if line:
        out = out.unionByName(now.where("kind = 'lasso'").select("series_key", "kind", line.column().alias("p")))
    return out.select("series_key", "kind", F.round("p", 6).alias("predicted"))


_ERR = "CASE WHEN abs({v}) + abs({p}) = 0 THEN 0 ELSE 200 * abs({v} - {p}) / (abs({v}) + abs({p})) END"


@query(with_(FINE, """pg AS (SELECT series_key, year, committed, substr(md5(series_key), 1, 2) AS g FROM fine)""", """pa AS (SELECT *, row_number() OVER (PARTITION BY year, g ORDER BY series_key) AS i FROM pg)""", """pb AS (SELECT year, g, committed AS other, row_number() OVER (PARTITION BY year, g ORDER BY md5(concat_ws(':', series_key, year, 7)), series_key) AS i FROM pg)""", f"""pe AS (
  SELECT * FROM (SELECT year, committed, other, lag(committed) OVER w AS t, lag(other) OVER w AS s FROM pa JOIN pb USING (year, g, i) WINDOW w AS (PARTITION BY series_key ORDER BY year)) WHERE year = {TARGET})""") + f"SELECT 'true' AS kind, round(avg({_ERR.format(v='committed', p='t')}), 4) AS smape FROM pe UNION ALL SELECT 'permuted', round(avg({_ERR.format(v='other', p='s')}), 4) FROM pe")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the last value on the true series and on values exchanged between the series of a year: it must grow."""
    return L.permuted_error(fine(spark, sf_dir).select("series_key", "year", "committed"), TARGET, seed=7)


def _uniform_sql(seed: int) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', series_key, quarter, {seed})), 1, 8) AS BIGINT) + 0.5) / 4294967296)"


@query(with_(QUARTERS, WIDE_SQL, f"sq AS (SELECT series_key, unnest([1, 2, 3, 4]) AS quarter, unnest([t1, t2, t3, t4]) AS base FROM wide WHERE year = {TARGET})", f"""sn AS (
  SELECT series_key, CAST(quarter AS INT) AS quarter, base, least(greatest(base + 0.05 * sqrt(-2 * ln({_uniform_sql(12)})) * cos(2 * pi() * {_uniform_sql(13)}), 0), 1) AS v FROM sq WHERE base IS NOT NULL)""") + """
SELECT series_key, quarter, round(max(v) OVER (PARTITION BY series_key ORDER BY quarter), 6) AS taux FROM (SELECT series_key, quarter, least(v * k, 1) AS v FROM sn JOIN (SELECT quarter, avg(base) / avg(v) AS k FROM sn GROUP BY 1) USING (quarter))""")
def constrained_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines, clipped, scaled to the quarter's aggregate and never falling within a year."""
    return L.simulate_lines(wide(spark, sf_dir).where(F.col("year") == TARGET), seed=11)


@query(with_(QUARTERS, WIDE_SQL) + f"""SELECT series_key, year, round((t2 - med) / nullif(iqr, 0), 6) AS t2_scaled FROM wide, (SELECT median(t2) AS med, quantile_cont(t2, 0.75) - quantile_cont(t2, 0.25) AS iqr FROM wide WHERE year < {TARGET})""")
def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature scaled by median and quartile distance, both exact."""
    w = wide(spark, sf_dir)
    fit = quantiles(w.where(F.col("year") < TARGET), "t2", {"med": 0.5, "lo": 0.25, "hi": 0.75}).select("med", (F.col("hi") - F.col("lo")).alias("iqr"))
    return w.crossJoin(F.broadcast(fit)).select("series_key", "year", F.round((F.col("t2") - F.col("med")) / F.nullif(F.col("iqr"), F.lit(0.0)), 6).alias("t2_scaled"))
