"""Selection, ensembles, intervals, scenarios and back-test metrics on long predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import series as S
from ..operators.methods import METHODS as METHODS_BY_NAME
from ..operators.methods import Fitted, long_predictions
from ..operators.windows import quantiles, ranked_values
from ..settings import METHODS
from ..sources.panels import TARGET, fine
from ..sources.shared import written_once
from .base_sql import FINE, with_
from .forecasts import CREDITS_SQL, GROWTH_SQL, HIST, METHOD_SQL, RATE_MODEL_SQL, RECENT_SQL, SMAPE, exec_rate, growth, history, rate_models, target
from .learning import ridge_sql
from .registry import NOT_SQL, query

FOUR = METHODS
VALID = (TARGET - 2, TARGET - 1, TARGET)


def long_form(df: DataFrame, keep: list[str], methods: dict[str, Column]) -> DataFrame:
    """keep columns, method, predicted: one row a method, from one projection (no join, no shuffle)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.alias("predicted")) for k, v in methods.items()]))
    return df.select(*keep, stacked.alias("_m")).select(*keep, "_m.method", "_m.predicted").where("predicted IS NOT NULL")


def scored(df: DataFrame) -> DataFrame:
    """Adds abs_error and smape to actual and predicted."""
    return df.withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted"))).withColumn("smape", S.smape(F.col("actual"), F.col("predicted")))


def walk(spark: SparkSession, sf_dir: str, years: tuple[int, ...] = VALID, least: int = 2) -> DataFrame:
    """series_key, l1, year, actual, h, hy: each validation year with all earlier values of its series and their years; one shuffle by series, no self-join."""
    all_years = S.collapse(fine(spark, sf_dir), ["series_key"], "year", "committed", keep=("l1",)).select("series_key", "l1", F.explode(F.arrays_zip("years", "committeds")).alias("p"), F.arrays_zip("years", "committeds").alias("z"))
    at = all_years.where(F.col("p.years").isin(*years))
    past = at.select("series_key", "l1", F.col("p.years").alias("year"), F.col("p.committeds").alias("actual"), F.filter("z", lambda x: x["years"] < F.col("p.years")).alias("past")).where(F.size("past") >= least)
    pick = lambda c: F.transform("past", lambda x: x[c])
    return past.select("series_key", "l1", "year", "actual", pick("committeds").alias("h"), pick("years").alias("hy"))


def walked(spark: SparkSession, sf_dir: str, years: tuple[int, ...] = VALID) -> DataFrame:
    """Long scored predictions of the methods of the settings for each validation year."""
    return contest(spark, sf_dir, FOUR, years)


def contest(spark: SparkSession, sf_dir: str, methods: tuple[str, ...], years: tuple[int, ...] = VALID, least: int = 2) -> DataFrame:
    """Long scored predictions of closed and fitted methods for each validation year: series_key, l1, year, actual, method, predicted, abs_error, smape.

    With fitted methods the panel is written once and each year's models learn from strictly earlier rows of it.
    """
    rows, keep, panel = walk(spark, sf_dir, years, least), ["series_key", "l1", "year", "actual"], None
    if any(isinstance(METHODS_BY_NAME[m], Fitted) for m in methods):
        panel = written_once(fine(spark, sf_dir, until=max(years) + 1).select("series_key", "year", F.col("committed").alias("value")), "panel")
    return scored(long_predictions(rows, methods, keep, panel, years))


def _long_sql(methods: tuple[str, ...], source: str, keep: str) -> str:
    own = {m: METHOD_SQL[m] for m in methods if m in METHOD_SQL} | {m: "p" for m in methods if m == "Ridge"}
    return " UNION ALL ".join(f"SELECT {keep}, '{m}' AS method, {e} AS predicted FROM {'ridge_w' if m == 'Ridge' else source}" for m, e in own.items())


def walk_sql(years: tuple[int, ...] = VALID, methods: tuple[str, ...] = FOUR) -> str:
    """Common tables walk and preds; with methods that SQL can't express, marked so that no query is checked by it."""
    missing = [m for m in methods if m not in METHOD_SQL and m != "Ridge"]
    return (NOT_SQL if missing else "") + f"""walk AS (
  SELECT v.series_key, v.l1, v.year, v.committed AS actual, list(p.committed ORDER BY p.year) AS h, list(p.year ORDER BY p.year) AS ys
  FROM fine v JOIN fine p ON p.series_key = v.series_key AND p.year < v.year WHERE v.year IN {years} GROUP BY ALL HAVING count(*) >= 2),
{ridge_sql('ridge_w', 'walk', 's.year') + ',' if 'Ridge' in methods else ''}
raw AS ({_long_sql(methods, 'walk', 'series_key, l1, year, actual')}),
preds AS (SELECT *, abs(actual - predicted) AS abs_error, {SMAPE} AS smape FROM raw)"""


BEST_SQL = f"""best AS (
  SELECT series_key, method, err FROM (SELECT series_key, method, avg(smape) AS err, row_number() OVER (PARTITION BY series_key ORDER BY round(avg(smape), 6), method) AS rn
  FROM preds WHERE year < {TARGET} GROUP BY 1, 2) WHERE rn = 1)"""


def best_method(preds: DataFrame, key: str = "series_key", error: str = "smape") -> DataFrame:
    """key, method, err: the method with the least mean error of each key (six decimals; the first by name on ties), by aggregation alone."""
    means = preds.groupBy(key, "method").agg(F.avg(error).alias("err"))
    return means.groupBy(key).agg(F.min(F.struct(F.round("err", 6).alias("e"), "method", "err")).alias("b")).select(key, "b.method", "b.err")


@query(with_(FINE, walk_sql()) + "SELECT series_key, year, method, round(actual, 4) AS actual, round(predicted, 5) AS predicted, round(smape, 4) AS smape FROM preds")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of four methods for each of the last three years, from strictly earlier years."""
    return walked(spark, sf_dir).select("series_key", "year", "method", F.round("actual", 4).alias("actual"), F.round("predicted", 5).alias("predicted"), F.round("smape", 4).alias("smape"))


@query(with_(FINE, walk_sql(), BEST_SQL) + f"""SELECT series_key, method, round(err, 4) AS validation_smape, round(p.predicted, 5) AS predicted, round(p.actual, 4) AS actual, round(p.smape, 4) AS smape
FROM best JOIN preds p USING (series_key, method) WHERE p.year = {TARGET}""", "best_method")
def best_method_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of four methods over two validation years, with its forecast and error for the target year.

    Errors and target rows come from one aggregation and the winner from a second; both find their rows where the series were collapsed.
    """
    return winners(walked(spark, sf_dir))


def winners(preds: DataFrame) -> DataFrame:
    """series_key, method, validation_smape, predicted, actual, smape: the method with the least mean error before the target year, with its forecast of that year."""
    return winners_of(both_errors(preds), 5, 4)


def both_errors(preds: DataFrame) -> DataFrame:
    """series_key, method, err (mean error before the target year) and t, its row of the target year."""
    now = F.col("year") == TARGET
    return preds.groupBy("series_key", "method").agg(F.avg(F.when(~now, F.col("smape"))).alias("err"), F.max(F.when(now, F.struct("predicted", "actual", "smape"))).alias("t"))


def winners_of(both: DataFrame, digits: int, error_digits: int) -> DataFrame:
    best = both.where("err IS NOT NULL").groupBy("series_key").agg(F.min(F.struct(F.round("err", 6).alias("e"), "method", "err", "t")).alias("b")).where("b.t IS NOT NULL")
    return best.select("series_key", "b.method", F.round("b.err", 4).alias("validation_smape"), F.round("b.t.predicted", digits).alias("predicted"), F.round("b.t.actual", 4).alias("actual"), F.round("b.t.smape", error_digits).alias("smape"))


#: Contestants of the reports' model choice (fixed values): three closed forms, a ridge of each series and one boosted model over all of them.
FIVE = ("Naive", "Mean3", "TrendYears", "Ridge", "Boosting")
_RIDGE = ("Mean3", "Median", "Naive", "Ridge", "Trend")


@query()
def best_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of the last value, three years' mean, line, ridge and boosting over two validation years, with its forecast and error for the target year."""
    return winners(contest(spark, sf_dir, FIVE))


@query(with_(FINE, walk_sql(methods=_RIDGE), BEST_SQL) + f"""SELECT series_key, method, round(err, 4) AS validation_smape, round(p.predicted, 0) AS predicted, round(p.actual, 4) AS actual, round(p.smape, 3) AS smape
FROM best JOIN preds p USING (series_key, method) WHERE p.year = {TARGET}""")
def best_with_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of four closed forms and each series' own ridge."""
    return winners_of(both_errors(contest(spark, sf_dir, _RIDGE)), 0, 3)


@query(with_(FINE, walk_sql(methods=_RIDGE)) + "SELECT year, method, count(*) AS n, round(avg(smape), 3) AS mean_smape, round(median(smape), 3) AS median_smape FROM preds GROUP BY 1, 2")
def rolling_with_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four closed forms and the ridge in each validation year."""
    return yearly_errors(written_once(contest(spark, sf_dir, _RIDGE), "contest"), 3)


@query()
def rolling_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five contestants in each validation year, ridge and boosting among them."""
    return yearly_errors(written_once(contest(spark, sf_dir, FIVE), "contest"), 4)


def yearly_errors(preds: DataFrame, digits: int) -> DataFrame:
    q = quantiles(preds, "smape", {"m": 0.5}, ("year", "method")).select("year", "method", F.round("m", digits).alias("median_smape"))
    return preds.groupBy("year", "method").agg(F.count("*").alias("n"), F.round(F.avg("smape"), digits).alias("mean_smape")).join(q, ["year", "method"])


@query(with_(FINE, walk_sql(VALID[1:])) + f"""SELECT series_key, picked, round(predicted, 5) AS predicted, round(smape, 4) AS smape FROM (
  SELECT t.series_key, v.method AS picked, t.predicted, t.smape FROM (
    SELECT series_key, method FROM (SELECT series_key, method, row_number() OVER (PARTITION BY series_key ORDER BY round(smape, 6), method) AS rn FROM preds WHERE year = {TARGET - 1}) WHERE rn = 1) v
  JOIN preds t ON t.series_key = v.series_key AND t.method = v.method AND t.year = {TARGET})""")
def nested_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method that won the last known year predicts the target year."""
    preds = walked(spark, sf_dir, VALID[1:])
    picked = best_method(preds.where(F.col("year") == TARGET - 1)).select("series_key", "method")
    return preds.where(F.col("year") == TARGET).join(picked, ["series_key", "method"]).select("series_key", F.col("method").alias("picked"), F.round("predicted", 5).alias("predicted"), F.round("smape", 4).alias("smape"))


LEADER_SQL = f"""SELECT method, count(*) AS n, round(avg(smape), 4) AS mean_smape, round(median(smape), 4) AS median_smape, round(quantile_cont(smape, 0.75), 4) AS p75, round(quantile_cont(smape, 0.9), 4) AS p90,
  round(max(smape), 4) AS max_smape, round(avg(CAST(smape <= 10 AS INT)) * 100, 4) AS within_10, round(avg(CAST(smape <= 25 AS INT)) * 100, 4) AS within_25, round(avg(CAST(smape <= 50 AS INT)) * 100, 4) AS within_50,
  round((sum(predicted) - sum(actual)) / sum(actual) * 100, 4) AS bias FROM preds WHERE year = {TARGET} GROUP BY 1"""


@query(with_(FINE, walk_sql()) + LEADER_SQL)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error distribution of each method in the target year; its quantiles are exact without a sort of all errors in one task."""
    share = lambda k: F.round(F.avg((F.col("smape") <= k).cast("int")) * 100, 4).alias(f"within_{k}")
    preds = written_once(walked(spark, sf_dir, (TARGET,)).select("method", "actual", "predicted", "smape"), "predictions")
    stats = preds.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("smape"), 4).alias("mean_smape"), F.round(F.max("smape"), 4).alias("max_smape"), share(10), share(25), share(50), F.round((F.sum("predicted") - F.sum("actual")) / F.sum("actual") * 100, 4).alias("bias"))
    q = quantiles(preds, "smape", {"median_smape": 0.5, "p75": 0.75, "p90": 0.9}, ("method",))
    return stats.join(q.select("method", *[F.round(c, 4).alias(c) for c in ("median_smape", "p75", "p90")]), "method")


@query(with_(FINE, walk_sql()) + f"""SELECT method, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (
  SELECT series_key, method, row_number() OVER (PARTITION BY series_key ORDER BY round(smape, 6), method) AS rn FROM preds WHERE year = {TARGET}) WHERE rn = 1 GROUP BY 1""")
def method_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each method is best in hindsight."""
    wins = best_method(walked(spark, sf_dir, (TARGET,))).groupBy("method").agg(F.count("*").alias("wins"))
    return wins.select("method", "wins", F.round(F.col("wins") / F.sum("wins").over(W.partitionBy()), 6).alias("share"))


@query(with_(FINE, walk_sql()) + """SELECT p.method, round(1 - sum(p.abs_error) / sum(n.abs_error), 6) AS skill, round(avg(CAST(p.abs_error < n.abs_error AS INT)) * 100, 4) AS better_pct
FROM preds p JOIN preds n ON p.series_key = n.series_key AND p.year = n.year AND n.method = 'Naive' WHERE p.method <> 'Naive' GROUP BY 1""")
def skill_vs_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of each method relative to the last value, over the same series and years; the base error rides along in a window, not a join."""
    own = W.partitionBy("series_key", "year")
    df = walked(spark, sf_dir).withColumn("base", F.max(F.when(F.col("method") == "Naive", F.col("abs_error"))).over(own)).where("method <> 'Naive'")
    return df.groupBy("method").agg(F.round(1 - F.sum("abs_error") / F.sum("base"), 6).alias("skill"), F.round(F.avg((F.col("abs_error") < F.col("base")).cast("int")) * 100, 4).alias("better_pct"))


@query(with_(FINE, walk_sql()) + """SELECT year, method, round(sum(abs_error) / sum(abs(actual)) * 100, 4) AS wape, round((sum(predicted) - sum(actual)) / sum(actual) * 100, 4) AS bias,
  round(avg(CAST(smape < 20 AS INT)) * 100, 4) AS under_20, round(avg(CAST(smape > 50 AS INT)) * 100, 4) AS over_50 FROM preds GROUP BY 1, 2""")
def wape_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted error, bias and shares of small and large errors by year and method."""
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 4)
    return walked(spark, sf_dir).groupBy("year", "method").agg(F.round(F.sum("abs_error") / F.sum(F.abs("actual")) * 100, 4).alias("wape"), F.round((F.sum("predicted") - F.sum("actual")) / F.sum("actual") * 100, 4).alias("bias"), share(F.col("smape") < 20).alias("under_20"), share(F.col("smape") > 50).alias("over_50"))


@query(with_(FINE, walk_sql()) + "SELECT year, " + ", ".join(f"round(avg((predicted - actual) / nullif(actual, 0)) FILTER (method = '{m}') * 100, 4) AS \"{m}\"" for m in FOUR) + " FROM preds GROUP BY 1")
def bias_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean signed error in percent, years by methods."""
    signed = F.try_divide(F.col("predicted") - F.col("actual"), F.col("actual"))
    return walked(spark, sf_dir).withColumn("e", signed).groupBy("year").pivot("method", list(FOUR)).agg(F.round(F.avg("e") * 100, 4))


@query(with_(FINE, walk_sql()) + """, rm AS (SELECT l1, method, year, sqrt(avg(abs_error * abs_error)) AS rmse, avg(abs_error) AS mae, avg(CASE WHEN actual <> 0 THEN abs_error / abs(actual) END) * 100 AS mape FROM preds GROUP BY 1, 2, 3)
SELECT l1, year, method, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(mape, 4) AS mape FROM rm""")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and MAPE (without zero actuals) by category, fold and method."""
    return _folds(spark, sf_dir).select("l1", "year", "method", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("mape", 4).alias("mape"))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("abs_error")
    return walked(spark, sf_dir).groupBy("l1", "year", "method").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), (F.avg(F.when(F.col("actual") != 0, e / F.abs("actual"))) * 100).alias("mape"))


@query(with_(FINE, walk_sql(), "rm AS (SELECT l1, year, method, sqrt(avg(abs_error * abs_error)) AS rmse FROM preds GROUP BY 1, 2, 3)") + """SELECT l1, method, count(*) AS folds_won, round(min(best), 3) AS least_rmse FROM (
  SELECT l1, year, method, rmse AS best, row_number() OVER (PARTITION BY l1, year ORDER BY round(rmse, 6), method) AS rn FROM rm) WHERE rn = 1 GROUP BY 1, 2""")
def fold_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner of each fold and how many folds each method won, by category."""
    won = _folds(spark, sf_dir).groupBy("l1", "year").agg(F.min(F.struct(F.round("rmse", 6).alias("r"), "method", "rmse")).alias("b")).select("l1", "b.method", "b.rmse")
    return won.groupBy("l1", "method").agg(F.count("*").alias("folds_won"), F.round(F.min("rmse"), 3).alias("least_rmse"))


@query(with_(FINE, walk_sql()) + f""", lvl AS (SELECT series_key, avg(committed) AS m, stddev_samp(committed) / nullif(avg(committed), 0) AS cv FROM fine WHERE year < {TARGET} GROUP BY 1),
edge AS (SELECT quantile_cont(m, 1.0 / 3) AS m1, quantile_cont(m, 2.0 / 3) AS m2, quantile_cont(cv, 1.0 / 3) AS c1, quantile_cont(cv, 2.0 / 3) AS c2 FROM lvl)
SELECT CASE WHEN m <= m1 THEN 'small' WHEN m <= m2 THEN 'medium' ELSE 'large' END AS size, CASE WHEN cv <= c1 THEN 'calm' WHEN cv <= c2 THEN 'mixed' ELSE 'wild' END AS volatility, method,
  count(*) AS n, round(avg(smape), 4) AS mean_smape, round(median(smape), 4) AS median_smape FROM preds JOIN lvl USING (series_key), edge WHERE year = {TARGET} AND cv IS NOT NULL GROUP BY 1, 2, 3""")
def segment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by size and volatility tercile (edges by interpolated quantiles; the edge belongs to the lower bin)."""
    lvl = fine(spark, sf_dir, until=TARGET).groupBy("series_key").agg(F.avg("committed").alias("m"), F.try_divide(F.stddev_samp("committed"), F.avg("committed")).alias("cv"))
    edge = quantiles(lvl, "m", {"m1": 1 / 3, "m2": 2 / 3}).crossJoin(F.broadcast(quantiles(lvl, "cv", {"cv1": 1 / 3, "cv2": 2 / 3})))
    cut = lambda c, names: F.when(F.col(c) <= F.col(f"{c}1"), names[0]).when(F.col(c) <= F.col(f"{c}2"), names[1]).otherwise(names[2])
    df = walked(spark, sf_dir, (TARGET,)).join(lvl, "series_key").crossJoin(F.broadcast(edge)).where("cv IS NOT NULL")
    df = df.select(cut("m", ("small", "medium", "large")).alias("size"), cut("cv", ("calm", "mixed", "wild")).alias("volatility"), "method", "smape")
    by = ("size", "volatility", "method")
    q = quantiles(df, "smape", {"q": 0.5}, by).select(*by, F.round("q", 4).alias("median_smape"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("smape"), 4).alias("mean_smape")).join(q, list(by))


_WIN = ", ".join(f"avg(CASE WHEN abs(actual) + abs({c}) = 0 THEN 0 ELSE 100 * abs(actual - {c}) / ((abs(actual) + abs({c})) / 2) END) AS {c}" for c in ("a", "b"))


@query(with_(FINE, walk_sql((TARGET,))) + f"""SELECT l1, round(a, 4) AS smape_all_years, round(b, 4) AS smape_three_years, round(b - a, 4) AS delta FROM (
  SELECT l1, {_WIN} FROM (SELECT l1, actual, list_avg(h) AS a, {METHOD_SQL['Mean3']} AS b FROM walk) GROUP BY 1)""")
def window_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training on all earlier years against the last three."""
    w = walk(spark, sf_dir, (TARGET,))
    err = lambda p: F.avg(S.smape(F.col("actual"), p))
    out = w.groupBy("l1").agg(err(S.mean(F.col("h"))).alias("a"), err(S.mean3(F.col("h"))).alias("b"))
    return out.select("l1", F.round("a", 4).alias("smape_all_years"), F.round("b", 4).alias("smape_three_years"), F.round(F.col("b") - F.col("a"), 4).alias("delta"))


@query(with_(FINE, walk_sql()) + f"""SELECT 'violations' AS audit, CAST(count(*) FILTER (p.year >= v.year) AS DOUBLE) AS value FROM fine v JOIN fine p ON p.series_key = v.series_key AND p.year < v.year WHERE v.year IN {VALID}
UNION ALL SELECT 'honest_smape', round(avg(smape), 4) FROM preds WHERE method = 'Naive' AND year = {TARGET}
UNION ALL SELECT 'leaky_smape', round(avg(CASE WHEN actual = 0 THEN 0 ELSE 0 END), 4) FROM preds WHERE method = 'Naive' AND year = {TARGET}""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training years not before the year predicted (must be none), and how the error collapses once the target leaks into the history."""
    y = F.col("p.years")
    z = S.collapse(fine(spark, sf_dir), ["series_key"], "year", "committed").select("years", F.explode(F.arrays_zip("years", "committeds")).alias("p"))
    late = z.where(y.isin(*VALID)).agg(F.sum(F.size(F.filter(F.filter("years", lambda t: t < y), lambda t: t >= y))).cast("double").alias("value")).select(F.lit("violations").alias("audit"), "value")
    w = walk(spark, sf_dir, (TARGET,))
    honest = w.agg(F.round(F.avg(S.smape(F.col("actual"), S.naive(F.col("h")))), 4).alias("value")).select(F.lit("honest_smape").alias("audit"), "value")
    leaky = w.agg(F.round(F.avg(S.smape(F.col("actual"), S.naive(F.concat("h", F.array("actual"))))), 4).alias("value")).select(F.lit("leaky_smape").alias("audit"), "value")
    return late.unionByName(honest).unionByName(leaky)


@query(with_(FINE, walk_sql()) + f"""SELECT a.method AS picked_before, b.method AS picked_after, count(*) AS n FROM
  (SELECT series_key, method FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(smape, 6), method) AS rn FROM preds WHERE year = {TARGET - 1}) WHERE rn = 1) a JOIN
  (SELECT series_key, method FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(smape, 6), method) AS rn FROM preds WHERE year = {TARGET}) WHERE rn = 1) b USING (series_key) GROUP BY 1, 2""")
def choice_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which method wins one year and the next."""
    preds = walked(spark, sf_dir, VALID[1:])
    pick = lambda y, c: best_method(preds.where(F.col("year") == y)).select("series_key", F.col("method").alias(c))
    return pick(TARGET - 1, "picked_before").join(pick(TARGET, "picked_after"), "series_key").groupBy("picked_before", "picked_after").agg(F.count("*").alias("n"))


# --- ensembles -------------------------------------------------------------------------------------
PARTS_SQL = f"""parts AS (SELECT series_key, l1, h, ys, actual, credits, {METHOD_SQL['Naive']} AS nv, {METHOD_SQL['Naive']} * g AS dn, {RECENT_SQL} * {CREDITS_SQL} AS er, {METHOD_SQL['RobustMean']} AS rb
  FROM hist JOIN target USING (series_key), growth)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and target with nv (last value), dn (drift), er (rate), rb (robust mean)."""
    # one collapse of all years, cut up afterwards: every branch of a plan then reads the same shuffle
    z = F.arrays_zip("years", "committeds", "openeds", "rates")
    now = lambda c: F.get(F.filter("z", lambda x: x["years"] == TARGET), F.lit(0))[c]
    rows = S.collapse(fine(spark, sf_dir), ["series_key"], "year", "committed", "opened", "rate", keep=("l1",)).select("series_key", "l1", z.alias("z"))
    cut = rows.select("series_key", "l1", F.filter("z", lambda x: x["years"] < TARGET).alias("past"), now("committeds").alias("actual"), now("openeds").alias("credits")).where((F.size("past") >= 3) & F.col("actual").isNotNull())
    pick = lambda c: F.transform("past", lambda x: x[c])
    h = cut.select("series_key", "l1", "actual", "credits", pick("years").alias("years"), pick("committeds").alias("h"), pick("openeds").alias("cs"), F.filter(pick("rates"), lambda r: r.isNotNull()).alias("rs"))
    h = h.crossJoin(F.broadcast(growth(spark, sf_dir, fine(spark, sf_dir))))
    return h.select("series_key", "l1", "h", "years", "rs", "cs", "actual", "credits", "g", S.naive(F.col("h")).alias("nv"), (S.naive(F.col("h")) * F.col("g")).alias("dn"), exec_rate(h).alias("er"), S.robust_mean(F.col("h")).alias("rb"))


_MED3 = "list_median(list_filter([dn, nv, er], lambda x: x IS NOT NULL))"


def med3() -> Column:
    return S.median(F.filter(F.array("dn", "nv", "er"), lambda x: x.isNotNull()))


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL) + f"SELECT series_key, round({_MED3}, 4) AS ens_median, round(list_avg(list_filter([dn, nv, er], lambda x: x IS NOT NULL)), 4) AS ens_mean FROM parts")
def ensemble_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean of three methods."""
    three = F.filter(F.array("dn", "nv", "er"), lambda x: x.isNotNull())
    return parts(spark, sf_dir).select("series_key", F.round(S.median(three), 4).alias("ens_median"), F.round(S.mean(three), 4).alias("ens_mean"))


_TEN = "[" + ", ".join(METHOD_SQL[m] for m in sorted(METHOD_SQL)) + "]"


@query(with_(FINE, HIST, f"ten AS (SELECT series_key, {_TEN} AS p FROM hist)") + "SELECT series_key, round((list_sum(p) - list_min(p) - list_max(p)) / (len(p) - 2), 4) AS ens_trimmed FROM ten")
def ensemble_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of all ten methods without the smallest and the largest."""
    p = F.array(*[S.METHODS[m](F.col("h")) for m in sorted(S.METHODS)])
    h = history(spark, sf_dir).select("series_key", p.alias("p"))
    return h.select("series_key", F.round((S.total(F.col("p")) - F.array_min("p") - F.array_max("p")) / (F.size("p") - 2), 4).alias("ens_trimmed"))


@query(with_(FINE, walk_sql(), f"wt AS (SELECT series_key, method, 1 / (avg(abs_error) + 1) AS w FROM preds WHERE year < {TARGET} GROUP BY 1, 2)") + f"SELECT series_key, round(sum(w * predicted) / sum(w), 4) AS stacked FROM wt JOIN preds USING (series_key, method) WHERE year = {TARGET} GROUP BY 1")
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods weighted by the inverse of their mean error in the validation years; weights and forecasts meet in one aggregation."""
    past = F.when(F.col("year") < TARGET, F.col("abs_error"))
    df = walked(spark, sf_dir).groupBy("series_key", "method").agg((1 / (F.avg(past) + 1)).alias("w"), F.max(F.when(F.col("year") == TARGET, F.col("predicted"))).alias("p")).where("p IS NOT NULL AND w IS NOT NULL")
    return df.groupBy("series_key").agg(F.round(F.sum(F.col("w") * F.col("p")) / F.sum("w"), 4).alias("stacked"))


_CV = "list_stddev_pop(h) / nullif(list_avg(h), 0)"
_CLIP = "CASE WHEN nv > 0 THEN least(greatest({p}, 0.3 * nv), 3 * nv) ELSE greatest({p}, 0) END"


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, f"routed AS (SELECT series_key, nv, CASE WHEN {_CV} < 0.15 THEN nv WHEN {_CV} < 0.40 THEN {_MED3} ELSE rb END AS p FROM parts)") + f"SELECT series_key, round({_CLIP.format(p='p')}, 6) AS routed FROM routed")
def vol_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method by coefficient of variation, kept within 0.3 to 3 times the last value."""
    cv = F.try_divide(S.stddev(F.col("h")), S.mean(F.col("h")))
    p = F.when(cv < 0.15, F.col("nv")).when(cv < 0.40, med3()).otherwise(F.col("rb"))
    return parts(spark, sf_dir).select("series_key", "h", p.alias("p")).select("series_key", F.round(S.around_last(F.col("p"), F.col("h")), 6).alias("routed"))


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, f"clipped AS (SELECT series_key, nv, {_CLIP.format(p=_MED3)} AS p FROM parts)", "tot AS (SELECT sum(nv) AS a, sum(p) AS b FROM clipped)") + "SELECT series_key, round(p * a * g / b, 3) AS corrected FROM clipped, tot, growth")
def bias_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble scaled so that its total is the last total times the growth."""
    df = parts(spark, sf_dir).select("series_key", "g", "nv", S.around_last(med3(), F.col("h")).alias("p"))
    tot = df.agg(F.sum("nv").alias("a"), F.sum("p").alias("b"))
    return df.crossJoin(F.broadcast(tot)).select("series_key", F.round(F.col("p") * F.col("a") * F.col("g") / F.col("b"), 3).alias("corrected"))


def smart_sql(med: str = _MED3) -> str:
    before = "(CASE WHEN len(h) > 1 THEN list_median(h[1:len(h) - 1]) ELSE nv END)"
    return f"(CASE WHEN nv = 0 AND coalesce(h[len(h) - 1], 1) = 0 THEN 0 WHEN nv = 0 THEN (CASE WHEN {med} > 0 THEN 0.5 * {med} ELSE 0 END) WHEN {before} > 0 AND nv / {before} < 0.3 THEN nv WHEN {before} > 0 AND nv / {before} > 3.0 THEN 0.7 * nv + 0.3 * {before} ELSE {med} END)"


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL) + f"SELECT series_key, round({smart_sql()}, 4) AS predicted, round(actual, 4) AS actual FROM parts")
def smart_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of three with rules for dead, reviving and broken series."""
    return parts(spark, sf_dir).select("series_key", F.round(S.smart(F.col("h"), F.col("dn"), F.col("er")), 4).alias("predicted"), F.round("actual", 4).alias("actual"))


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, f"sm AS (SELECT series_key, nv, actual, {smart_sql()} AS sm FROM parts)", f"""grid AS (
  SELECT CAST(i AS INT) AS i, median(CASE WHEN abs(actual) + abs(p) = 0 THEN 0 ELSE 100 * abs(actual - p) / ((abs(actual) + abs(p)) / 2) END) AS m
  FROM (SELECT i, actual, i / 20.0 * sm + (1 - i / 20.0) * nv AS p FROM sm, (SELECT unnest(range(0, 21)) AS i)) GROUP BY 1)""") + "SELECT i, round(m, 4) AS median_smape, row_number() OVER (ORDER BY round(m, 6), i) = 1 AS best FROM grid")
def blend_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend of ensemble and last value in steps of a twentieth, by median error; all 21 blends come from one projection."""
    sm = parts(spark, sf_dir).select("nv", "actual", S.smart(F.col("h"), F.col("dn"), F.col("er")).alias("sm"))
    p = F.col("i") / 20 * F.col("sm") + (1 - F.col("i") / 20) * F.col("nv")
    blends = sm.select("*", F.explode(F.array(*[F.lit(i) for i in range(21)])).alias("i")).select("i", S.smape(F.col("actual"), p).alias("e"))
    grid = quantiles(blends, "e", {"m": 0.5}, ("i",))
    return grid.select("i", F.round("m", 4).alias("median_smape"), (F.row_number().over(W.partitionBy().orderBy(F.round("m", 6), "i")) == 1).alias("best"))


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_key, y, v, p: rolling ensemble forecasts from the third training year on."""
    df = parts(spark, sf_dir)
    at = df.select("series_key", "g", "h", "cs", F.explode(F.sequence(F.lit(3), F.size("h"))).alias("i"))
    past, v, c = F.slice("h", 1, F.col("i") - 1), F.element_at("h", F.col("i")), F.element_at("cs", F.col("i"))
    rates_ = F.filter(F.transform(F.arrays_zip(past.alias("v"), F.slice("cs", 1, F.col("i") - 1).alias("c")), lambda x: F.when(x["c"] > 0, x["v"] / x["c"])), lambda r: r.isNotNull())
    credits_ = F.coalesce(F.when(c > 0, c), F.element_at(F.filter(F.reverse(F.slice("cs", 1, F.col("i") - 1)), lambda x: x > 0), 1))
    df = at.select("series_key", v.alias("v"), past.alias("h"), (S.last(past) * F.col("g")).alias("dn"), rates_.alias("rs"), credits_.alias("c"))
    return df.select("series_key", "v", S.smart(F.col("h"), F.col("dn"), S.recent_rate(F.col("rs")) * F.col("c")).alias("p"))


_CAL_SQL = f"""cal0 AS (SELECT series_key, h[i] AS v, h[1:i - 1] AS h, h[i - 1] AS nv, h[i - 1] * g AS dn, list_filter(list_transform(range(1, i), lambda k: CASE WHEN cs[k] > 0 THEN h[k] / cs[k] END), lambda r: r IS NOT NULL) AS rs,
    coalesce(CASE WHEN cs[i] > 0 THEN cs[i] END, list_filter(list_reverse(cs[1:i - 1]), lambda c: c > 0)[1]) AS credits FROM (SELECT *, unnest(range(3, len(h) + 1)) AS i FROM hist JOIN target USING (series_key), growth)),
cal1 AS (SELECT series_key, v, h, nv, dn, {RECENT_SQL} * credits AS er FROM cal0),
cal AS (SELECT abs(v - p) / greatest(abs(v), 1) AS r FROM (SELECT v, {smart_sql()} AS p FROM cal1)),
q AS (SELECT {', '.join(f"list_sort(list(r))[CAST(least(ceil((count(*) + 1) * {a}), count(*)) AS INT)] AS q{int(a * 100)}" for a in (0.8, 0.9, 0.95))} FROM cal)"""


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, _CAL_SQL, f"sm AS (SELECT series_key, actual, {smart_sql()} AS p FROM parts)") + "SELECT series_key, round(p, 4) AS predicted, " + ", ".join(f"round(greatest(0, p * (1 - q{k})), 3) AS lo{k}, round(p * (1 + q{k}), 3) AS hi{k}, CAST(actual BETWEEN greatest(0, p * (1 - q{k})) AND p * (1 + q{k}) AS INT) AS covered{k}" for k in (80, 90, 95)) + " FROM sm, q")
def conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands from pooled relative residuals of rolling forecasts: the k-th smallest, by a distributed rank of which only three rows are kept."""
    cal = _calibration(spark, sf_dir).select((F.abs(F.col("v") - F.col("p")) / F.greatest(F.abs("v"), F.lit(1.0))).alias("r"))
    q = order_statistics(cal, "r", {80: 0.8, 90: 0.9, 95: 0.95})
    sm = parts(spark, sf_dir).select("series_key", "actual", S.smart(F.col("h"), F.col("dn"), F.col("er")).alias("p")).crossJoin(F.broadcast(q))
    cols = []
    for k in (80, 90, 95):
        lo, hi = F.greatest(F.lit(0.0), F.col("p") * (1 - F.col(f"q{k}"))), F.col("p") * (1 + F.col(f"q{k}"))
        cols += [F.round(lo, 3).alias(f"lo{k}"), F.round(hi, 3).alias(f"hi{k}"), F.col("actual").between(lo, hi).cast("int").alias(f"covered{k}")]
    return sm.select("series_key", F.round("p", 4).alias("predicted"), *cols)


def order_statistics(df: DataFrame, value: str, levels: dict[int, float]) -> DataFrame:
    """One row with q<k>: the ceil((n + 1) * level)-th smallest value, n at most."""
    at = lambda a: F.min(F.when(F.col("upto") >= F.least(F.ceil((F.col("n") + 1) * F.lit(a)), F.col("n")), F.col(value)))
    return ranked_values(df, value).agg(*[at(a).alias(f"q{k}") for k, a in levels.items()])


@query(with_(FINE, walk_sql(), BEST_SQL) + f""", cb AS (SELECT quantile_cont(abs_error / actual, 0.9) AS q FROM best JOIN preds USING (series_key, method) WHERE year = {TARGET - 1} AND actual > 0)
SELECT series_key, round(predicted, 5) AS predicted, round(greatest(0, predicted * (1 - q)), 3) AS lo, round(predicted * (1 + q), 3) AS hi, CAST(actual BETWEEN greatest(0, predicted * (1 - q)) AND predicted * (1 + q) AS INT) AS covered FROM best JOIN preds USING (series_key, method), cb WHERE year = {TARGET}""")
def conformal_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands from the 90th percentile of the best method's relative errors in the calibration year."""
    preds = walked(spark, sf_dir)
    best = preds.join(best_method(preds.where(F.col("year") < TARGET)).select("series_key", "method"), ["series_key", "method"])
    q = best.where((F.col("year") == TARGET - 1) & (F.col("actual") > 0)).select((F.col("abs_error") / F.col("actual")).alias("e"))
    q = quantiles(q, "e", {"q": 0.9})
    p = F.col("predicted")
    lo, hi = F.greatest(F.lit(0.0), p * (1 - F.col("q"))), p * (1 + F.col("q"))
    return best.where(F.col("year") == TARGET).crossJoin(F.broadcast(q)).select("series_key", F.round(p, 5).alias("predicted"), F.round(lo, 3).alias("lo"), F.round(hi, 3).alias("hi"), F.col("actual").between(lo, hi).cast("int").alias("covered"))


_ORDER = list(RATE_MODEL_SQL)
RATE_BEST_SQL = f"""rb AS (SELECT series_key, method, predicted, actual, CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) * 100 END AS mape, rn FROM (
  SELECT series_key, method, predicted, actual, row_number() OVER (PARTITION BY series_key ORDER BY round(abs(actual - predicted) / abs(nullif(actual, 0)), 8) NULLS LAST, o) AS rn FROM (
  {' UNION ALL '.join(f"SELECT series_key, '{m}' AS method, {i} AS o, {RATE_MODEL_SQL[m]} AS predicted, actual / nullif(credits, 0) AS actual FROM hist JOIN target USING (series_key) WHERE len(rs) > 0" for i, m in enumerate(_ORDER))})))"""


def rate_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of five rate models in the target year, ties in model order: series_key, method, predicted, actual, mape, rs, cs."""
    h = history(spark, sf_dir).where(F.size("rs") > 0).join(target(spark, sf_dir), "series_key").withColumn("act", F.try_divide("actual", "credits"))
    err = lambda p: F.round(F.abs(F.col("act") - p) / F.abs(F.nullif(F.col("act"), F.lit(0.0))), 8)
    options = F.array(*[F.struct(F.coalesce(err(p), F.lit(1e300)).alias("e"), F.lit(i).alias("o"), F.lit(m).alias("method"), p.alias("predicted")) for i, (m, p) in enumerate(rate_models(F.col("rs")).items())])
    best = h.select("series_key", "rs", "cs", "credits", F.col("act").alias("actual"), F.array_min(options).alias("b"))
    return best.select("series_key", "rs", "cs", "credits", "actual", "b.method", "b.predicted", (F.abs(F.col("actual") - F.col("b.predicted")) / F.abs(F.nullif(F.col("actual"), F.lit(0.0))) * 100).alias("mape"))


@query(with_(FINE, HIST, RATE_BEST_SQL) + "SELECT series_key, method, round(predicted, 6) AS predicted, round(actual, 6) AS actual, round(mape, 4) AS mape, CASE WHEN mape IS NULL THEN 'manual' WHEN mape <= 20 THEN 'reliable' WHEN mape <= 50 THEN 'acceptable' WHEN mape <= 100 THEN 'uncertain' ELSE 'manual' END AS label FROM rb WHERE rn = 1")
def year_model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winning rate model of each series with its error and reliability label."""
    m = F.col("mape")
    label = F.when(m.isNull(), "manual").when(m <= 20, "reliable").when(m <= 50, "acceptable").when(m <= 100, "uncertain").otherwise("manual")
    return rate_tournament(spark, sf_dir).select("series_key", "method", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"), F.round(m, 4).alias("mape"), label.alias("label"))


def cv_label_sql(cv: str) -> str:
    return f"CASE WHEN {cv} IS NULL OR {cv} > 40 THEN 'uncertain' WHEN {cv} > 20 THEN 'acceptable' ELSE 'reliable' END"


@query(with_(FINE, HIST) + f"""SELECT series_key, round(cv, 6) AS cv, {cv_label_sql('cv * 100')} AS reliability, CASE WHEN n < 2 OR m = 0 THEN 'insufficient' WHEN cv < 0.10 THEN 'stable' WHEN cv < 0.25 THEN 'medium' ELSE 'unstable' END AS stability
FROM (SELECT series_key, len(rs) AS n, list_avg(rs) AS m, list_stddev_samp(rs) / nullif(list_avg(rs), 0) AS cv FROM hist)""")
def reliability_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability and stability classes by coefficient of variation of the rates."""
    return labelled(spark, sf_dir).select("series_key", F.round("cv", 6).alias("cv"), "reliability", "stability")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rs")
    h = history(spark, sf_dir).select("series_key", F.size(r).alias("n"), S.mean(r).alias("m"), F.try_divide(S.stddev(r, 1), S.mean(r)).alias("cv"))
    cv = F.col("cv")
    rel = F.when(cv.isNull() | (cv * 100 > 40), "uncertain").when(cv * 100 > 20, "acceptable").otherwise("reliable")
    sta = F.when((F.col("n") < 2) | (F.col("m") == 0), "insufficient").when(cv < 0.10, "stable").when(cv < 0.25, "medium").otherwise("unstable")
    return h.withColumns({"reliability": rel, "stability": sta})


#: Confidence by reliability and stability (fixed values); what is not listed must be checked.
CONFIDENCE = {("reliable", "stable"): "high", ("reliable", "medium"): "good", ("acceptable", "stable"): "good", ("acceptable", "medium"): "medium", ("reliable", "unstable"): "medium", ("acceptable", "unstable"): "low", ("uncertain", "medium"): "low", ("uncertain", "unstable"): "very low"}


@query(with_(FINE, HIST) + f"""SELECT series_key, coalesce(confidence, 'to check') AS confidence FROM (
  SELECT series_key, {cv_label_sql('cv * 100')} AS a, CASE WHEN n < 2 OR m = 0 THEN 'insufficient' WHEN cv < 0.10 THEN 'stable' WHEN cv < 0.25 THEN 'medium' ELSE 'unstable' END AS b
  FROM (SELECT series_key, len(rs) AS n, list_avg(rs) AS m, list_stddev_samp(rs) / nullif(list_avg(rs), 0) AS cv FROM hist))
LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for (a, b), c in CONFIDENCE.items())}) AS t(a, b, confidence) USING (a, b)""")
def confidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence looked up by reliability and stability. The lookup has a fixed number of rows, so it is broadcast."""
    look = spark.createDataFrame([(a, b, c) for (a, b), c in CONFIDENCE.items()], "reliability string, stability string, confidence string")
    return labelled(spark, sf_dir).join(F.broadcast(look), ["reliability", "stability"], "left").select("series_key", F.coalesce("confidence", F.lit("to check")).alias("confidence"))


_SC = {"cut": 0.9, "status_quo": 1.0, "rise": 1.1}


@query(with_(FINE, HIST, "base AS (SELECT l1, list_median(rs) * credits AS p FROM hist JOIN target USING (series_key) WHERE len(rs) > 0)", f"tot AS (SELECT l1, scenario, sum(p * f) AS total FROM base, (VALUES {', '.join(f'({k!r}, {v})' for k, v in _SC.items())}) AS s(scenario, f) GROUP BY GROUPING SETS ((l1, scenario), (scenario)))") + """
SELECT coalesce(t.l1, 'ALL') AS l1, t.scenario, round(t.total, 4) AS total, round((t.total / b.total - 1) * 100, 4) AS vs_status_quo FROM tot t JOIN tot b ON coalesce(t.l1, '') = coalesce(b.l1, '') AND b.scenario = 'status_quo'""")
def scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three credit scenarios by chapter and in all, against the status quo."""
    base = history(spark, sf_dir).where(F.size("rs") > 0).join(target(spark, sf_dir), "series_key").select("l1", (S.median(F.col("rs")) * F.col("credits")).alias("p"))
    tot = base.rollup("l1").agg(*[F.sum(F.col("p") * v).alias(k) for k, v in _SC.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.col(k).alias("total")) for k in _SC]))
    return tot.select(F.coalesce("l1", F.lit("ALL")).alias("l1"), "status_quo", rows.alias("r")).select("l1", "r.scenario", F.round("r.total", 4).alias("total"), F.round((F.col("r.total") / F.col("status_quo") - 1) * 100, 4).alias("vs_status_quo"))


@query(with_(FINE, HIST, f"up AS (SELECT series_key AS code, credits * 1.25 AS credit_{TARGET} FROM target WHERE series_key LIKE 'PROMO%')") + f"""SELECT series_key, round(coalesce(credit_{TARGET}, credits), 4) AS credits, round(list_median(rs) * coalesce(credit_{TARGET}, credits), 3) AS predicted, credit_{TARGET} IS NOT NULL AS uploaded
FROM hist JOIN target USING (series_key) LEFT JOIN up ON code = series_key WHERE len(rs) > 0""")
def scenario_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded scenario: its key and credit columns are found by name, missing series keep their credits."""
    from ..sources.files import find_column

    up = target(spark, sf_dir).where(F.col("series_key").startswith("PROMO")).select(F.col("series_key").alias("Line_Key"), (F.col("credits") * 1.25).alias(f"Credit_{TARGET}"))
    up = up.select(F.col(find_column(up, r"line[_ ]?key|code")).alias("series_key"), F.col(find_column(up, rf"credit.*{TARGET}|{TARGET}.*credit")).alias("given"))
    df = history(spark, sf_dir).where(F.size("rs") > 0).join(target(spark, sf_dir), "series_key").join(up, "series_key", "left")
    c = F.coalesce("given", "credits")
    return df.select("series_key", F.round(c, 4).alias("credits"), F.round(S.median(F.col("rs")) * c, 3).alias("predicted"), F.col("given").isNotNull().alias("uploaded"))
