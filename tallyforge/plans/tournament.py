"""Tournaments of all methods: adaptive choice by series, leaderboard ensembles, strategies against each other.

All ten closed-form methods are columns of one projection over collapsed histories, so a tournament costs the shuffle of its panel and small aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.methods import long_predictions
from ..operators.windows import quantiles
from ..sources.panels import TARGET, fine
from ..sources.shared import written_once
from .base_sql import FINE, with_
from .forecasts import GROWTH_SQL, HIST, METHOD_SQL, SMAPE, exec_rate, growth
from .registry import query
from .selection import _CLIP, _CV, _MED3, PARTS_SQL, VALID, long_form, med3, parts, scored, smart_sql, walk

TEN = tuple(sorted(S.METHODS))
#: What a series gets that no validation year can judge.
DEFAULT = "Theta"


def _struct_sql(methods: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"{{'method': '{m}', 'predicted': {METHOD_SQL[m]}}}" for m in methods) + "]"


def all_walked(spark: SparkSession, sf_dir: str, years: tuple[int, ...], least: int) -> DataFrame:
    """series_key, year, actual, n (years before), last, method, predicted, abs_error, smape of all ten methods, from strictly earlier years."""
    w = walk(spark, sf_dir, years, least).withColumns({"n": F.size("h"), "last": S.last(F.col("h"))})
    return scored(long_form(w, ["series_key", "year", "actual", "n", "last"], {m: S.METHODS[m](F.col("h")) for m in TEN}))


def _walked_sql(years: tuple[int, ...], least: int) -> str:
    return f"""w10 AS (
  SELECT v.series_key, v.year, v.committed AS actual, list(p.committed ORDER BY p.year) AS h
  FROM fine v JOIN fine p ON p.series_key = v.series_key AND p.year < v.year WHERE v.year IN {years} GROUP BY ALL HAVING count(*) >= {least}),
r10 AS (SELECT series_key, year, actual, len(h) AS n, h[len(h)] AS last, unnest({_struct_sql(TEN)}) AS m FROM w10),
p10 AS (SELECT *, {SMAPE} AS smape FROM (SELECT series_key, year, actual, n, last, m.method, m.predicted FROM r10) WHERE predicted IS NOT NULL)"""


_ADAPTIVE_SQL = f"""cv AS (SELECT series_key, method FROM (
  SELECT series_key, method, row_number() OVER (PARTITION BY series_key ORDER BY round(avg(smape), 6), method) AS rn FROM p10 WHERE year < {TARGET} GROUP BY 1, 2) WHERE rn = 1),
adaptive AS (SELECT t.series_key, coalesce(cv.method, '{DEFAULT}') AS picked, t.predicted, t.actual, t.smape
  FROM p10 t LEFT JOIN cv USING (series_key) WHERE t.year = {TARGET} AND t.n >= 3 AND t.method = coalesce(cv.method, '{DEFAULT}'))"""


def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_key, picked, predicted, actual, smape: each series' own best method over the validation years, Theta where there is none to judge by.

    A validation year counts with two earlier years, the target year with three. Errors and forecasts come from one aggregation, the winner from a second.
    """
    return adapted(all_walked(spark, sf_dir, VALID, 2))


def adapted(preds: DataFrame) -> DataFrame:
    """The adaptive choice from predictions of all ten methods (see all_walked)."""
    now = F.col("year") == TARGET
    forecast = F.max(F.when(now & (F.col("n") >= 3), F.struct("predicted", "actual", "smape")))
    both = preds.groupBy("series_key", "method").agg(F.avg(F.when(~now, F.col("smape"))).alias("err"), forecast.alias("t")).where("t IS NOT NULL")
    # methods without an error come last, and of these the default first
    order = F.struct(F.col("err").isNull().alias("unknown"), F.round("err", 6).alias("e"), F.when(F.col("err").isNull(), (F.col("method") != DEFAULT).cast("int")).otherwise(0).alias("other"), "method", "t")
    return both.groupBy("series_key").agg(F.min(order).alias("b")).select("series_key", F.col("b.method").alias("picked"), "b.t.predicted", "b.t.actual", "b.t.smape")


@query(with_(FINE, _walked_sql(VALID, 2), _ADAPTIVE_SQL) + "SELECT series_key, picked, round(predicted, 3) AS predicted, round(smape, 4) AS smape FROM adaptive")
def adaptive_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series is forecast by the method that cross-validation over its last years picks."""
    return adaptive(spark, sf_dir).select("series_key", "picked", F.round("predicted", 3).alias("predicted"), F.round("smape", 4).alias("smape"))


# --- leaderboard and its best three -----------------------------------------------------------------
_BOARD_SQL = f"""all12 AS (SELECT series_key, actual, m.method, m.predicted FROM (
  SELECT series_key, actual, unnest(list_concat({_struct_sql(TEN)}, [{{'method': 'DriftNaive', 'predicted': dn}}, {{'method': 'ExecRate', 'predicted': er}}])) AS m FROM parts) WHERE m.predicted IS NOT NULL),
s12 AS (SELECT *, {SMAPE} AS smape FROM all12),
board AS (SELECT method, count(*) AS n, avg(smape) AS mean_smape, median(smape) AS median_smape FROM s12 GROUP BY 1),
top3 AS (SELECT method FROM board ORDER BY round(median_smape, 6), method LIMIT 3)"""


def twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_key, actual, method, predicted, abs_error, smape for the target year: ten methods, drift and execution rate."""
    own = {m: S.METHODS[m](F.col("h")) for m in TEN} | {"DriftNaive": F.col("dn"), "ExecRate": F.col("er")}
    return scored(long_form(parts(spark, sf_dir), ["series_key", "actual"], own))


def best_three(preds: DataFrame) -> DataFrame:
    """The three methods with the least median error: three rows, so they can be broadcast."""
    return quantiles(preds, "smape", {"m": 0.5}, ("method",)).orderBy(F.round("m", 6), "method").limit(3).select("method")


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, _BOARD_SQL) + "SELECT series_key, round(median(predicted), 3) AS ens_median, round(avg(predicted), 3) AS ens_mean, string_agg(method, ',' ORDER BY method) AS methods FROM s12 JOIN top3 USING (method) GROUP BY 1")
def ensemble_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean of the three methods that lead the board."""
    preds = twelve(spark, sf_dir)
    p = F.collect_list("predicted")  # three at most
    mine = preds.join(F.broadcast(best_three(preds)), "method").groupBy("series_key").agg(p.alias("p"), F.array_join(F.array_sort(F.collect_list("method")), ",").alias("methods"))
    return mine.select("series_key", F.round(S.median(F.col("p")), 3).alias("ens_median"), F.round(S.mean(F.col("p")), 3).alias("ens_mean"), "methods")


@query(with_(FINE, _walked_sql(VALID, 3)) + """, y AS (SELECT year, method, count(*) AS n, round(avg(smape), 4) AS mean_smape, avg(smape) AS e, round(median(smape), 4) AS median_smape FROM p10 WHERE NOT (actual = 0 AND last = 0) GROUP BY 1, 2)
SELECT year, method, n, mean_smape, median_smape, row_number() OVER (PARTITION BY year ORDER BY round(e, 6), method) AS place FROM y""")
def rolling_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten methods in each validation year, with three earlier years or more; series that stay at zero are left out. place: by mean error."""
    from pyspark.sql import Window as W

    preds = written_once(all_walked(spark, sf_dir, VALID, 3).where(~((F.col("actual") == 0) & (F.col("last") == 0))).select("year", "method", "smape"), "tournament")
    q = quantiles(preds, "smape", {"m": 0.5}, ("year", "method")).select("year", "method", F.round("m", 4).alias("median_smape"))
    stats = preds.groupBy("year", "method").agg(F.count("*").alias("n"), F.avg("smape").alias("e"))
    place = F.row_number().over(W.partitionBy("year").orderBy(F.round("e", 6), "method"))
    return stats.join(q, ["year", "method"]).select("year", "method", "n", F.round("e", 4).alias("mean_smape"), "median_smape", place.alias("place"))


#: Strategies that are forecasts of their own for a series (fixed names), and the methods that stacking weighs.
MADE = ("Router", "Clipped", "Smart")
STACKED = ("Mean3", "Median", "Naive", "Trend")
_STRATEGY_SQL = f"""routed AS (SELECT series_key, actual, nv, CASE WHEN {_CV} < 0.15 THEN nv WHEN {_CV} < 0.40 THEN {_MED3} ELSE rb END AS p FROM parts),
clipped AS (SELECT series_key, actual, nv, {_CLIP.format(p=_MED3)} AS p FROM parts), tot AS (SELECT sum(nv) AS a, sum(p) AS b FROM clipped),
wt10 AS (SELECT series_key, method, 1 / (avg(abs(actual - predicted)) + 1) AS w FROM p10 WHERE year < {TARGET} AND method IN {STACKED} GROUP BY 1, 2),
st AS (
  SELECT 'Adaptive' AS strategy, actual, predicted FROM adaptive
  UNION ALL SELECT 'Oracle', actual, predicted FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(smape, 6), method) AS rn FROM s12) WHERE rn = 1
  UNION ALL SELECT 'MedianTop3', any_value(actual), median(predicted) FROM s12 JOIN top3 USING (method) GROUP BY series_key
  UNION ALL SELECT 'MeanTop3', any_value(actual), avg(predicted) FROM s12 JOIN top3 USING (method) GROUP BY series_key
  UNION ALL SELECT 'Trimmed', any_value(actual), (sum(predicted) - min(predicted) - max(predicted)) / (count(*) - 2) FROM s12 WHERE method NOT IN ('DriftNaive', 'ExecRate') GROUP BY series_key
  UNION ALL SELECT 'Stacking', any_value(actual), sum(w * predicted) / sum(w) FROM p10 JOIN wt10 USING (series_key, method) WHERE year = {TARGET} AND n >= 3 GROUP BY series_key
  UNION ALL SELECT 'Router', actual, {_CLIP.format(p='p')} FROM routed
  UNION ALL SELECT 'BiasCorrected', actual, p * a * g / b FROM clipped, tot, growth
  UNION ALL SELECT 'Smart', actual, {smart_sql()} FROM parts
  UNION ALL SELECT method, actual, predicted FROM s12),
ss AS (SELECT *, {SMAPE} AS smape FROM st WHERE predicted IS NOT NULL)"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions written once: series_key, year, actual, n, g, method, predicted, abs_error, smape.

    All ten methods for each validation year with two earlier years; for the target year and three earlier years also drift, execution rate and the strategies of MADE. One collapse of the panel, one projection.
    """
    z = F.arrays_zip("years", "committeds", "openeds", "rates")
    every = S.collapse(fine(spark, sf_dir), ["series_key"], "year", "committed", "opened", "rate").select("series_key", z.alias("z"))
    at = every.select("series_key", "z", F.explode(F.filter("z", lambda x: x["years"].isin(*VALID))).alias("p"))
    at = at.select("series_key", F.col("p.years").alias("year"), F.col("p.committeds").alias("actual"), F.col("p.openeds").alias("credits"), F.filter("z", lambda x: x["years"] < F.col("p.years")).alias("past")).where(F.size("past") >= 2)
    pick = lambda c: F.transform("past", lambda x: x[c])
    h = at.select("series_key", "year", "actual", "credits", F.size("past").alias("n"), pick("committeds").alias("h"), pick("openeds").alias("cs"), F.filter(pick("rates"), lambda r: r.isNotNull()).alias("rs"))
    h = h.crossJoin(F.broadcast(growth(spark, sf_dir)))
    h = h.select("*", S.naive(F.col("h")).alias("nv"), (S.naive(F.col("h")) * F.col("g")).alias("dn"), exec_rate(h).alias("er"), S.robust_mean(F.col("h")).alias("rb"))
    cv = F.try_divide(S.stddev(F.col("h")), S.mean(F.col("h")))
    routed = F.when(cv < 0.15, F.col("nv")).when(cv < 0.40, med3()).otherwise(F.col("rb"))
    late = {"DriftNaive": F.col("dn"), "ExecRate": F.col("er"), "Router": S.around_last(routed, F.col("h")), "Clipped": S.around_last(med3(), F.col("h")), "Smart": S.smart(F.col("h"), F.col("dn"), F.col("er"))}
    now = (F.col("year") == TARGET) & (F.col("n") >= 3)
    long = long_form(h, ["series_key", "year", "actual", "n", "g"], {m: S.METHODS[m](F.col("h")) for m in TEN} | {k: F.when(now, v) for k, v in late.items()})
    return written_once(scored(long), "board")


def strategies(preds: DataFrame) -> DataFrame:
    """strategy, actual, predicted for the target year, from the board: best in hindsight, adaptive, best three, trimmed, stacked, routed, bias-corrected, smart, and each method alone."""
    now = preds.where((F.col("year") == TARGET) & (F.col("n") >= 3))
    single = now.where(F.col("method").isin(*TEN, "DriftNaive", "ExecRate"))
    top = single.join(F.broadcast(best_three(single).withColumn("top", F.lit(True))), "method", "left")
    ten, p = F.col("method").isin(*TEN), F.col("predicted")
    own = top.groupBy("series_key").agg(
        F.first("actual").alias("actual"),
        F.min(F.struct(F.round("smape", 6).alias("e"), "method", "predicted")).alias("best"),
        F.collect_list(F.when(F.col("top"), p)).alias("lead"),
        ((F.sum(F.when(ten, p)) - F.min(F.when(ten, p)) - F.max(F.when(ten, p))) / (F.count_if(ten) - 2)).alias("trimmed"),
    )
    made = long_form(own, ["actual"], {"Oracle": F.col("best.predicted"), "MedianTop3": S.median(F.col("lead")), "MeanTop3": S.mean(F.col("lead")), "Trimmed": F.col("trimmed")})
    picked = adapted(preds.where(F.col("method").isin(*TEN))).select("actual", F.lit("Adaptive").alias("method"), "predicted")
    past, target = F.when(F.col("year") < TARGET, F.col("abs_error")), (F.col("year") == TARGET) & (F.col("n") >= 3)
    weighed = preds.where(F.col("method").isin(*STACKED)).groupBy("series_key", "method").agg((1 / (F.avg(past) + 1)).alias("w"), F.max(F.when(target, F.struct("predicted", "actual"))).alias("t")).where("t IS NOT NULL AND w IS NOT NULL")
    stacked = weighed.groupBy("series_key").agg(F.first("t.actual").alias("actual"), (F.sum(F.col("w") * F.col("t.predicted")) / F.sum("w")).alias("predicted")).select("actual", F.lit("Stacking").alias("method"), "predicted")
    at = lambda m: F.sum(F.when(F.col("method") == m, F.col("predicted")))
    scale = F.broadcast(now.agg((at("Naive") * F.first("g") / at("Clipped")).alias("k")))
    mended = now.where("method = 'Clipped'").crossJoin(scale).select("actual", F.lit("BiasCorrected").alias("method"), (F.col("predicted") * F.col("k")).alias("predicted"))
    others = now.where("method <> 'Clipped'").select("actual", "method", "predicted")
    return made.unionByName(picked).unionByName(stacked).unionByName(mended).unionByName(others).where("predicted IS NOT NULL").withColumnRenamed("method", "strategy")


def strategy_board(long: DataFrame) -> DataFrame:
    """strategy, n, mean and median error, shares of small errors and bias, of strategy, actual, predicted."""
    every = written_once(scored(long).select("strategy", "actual", "predicted", "smape"), "strategies")
    q = quantiles(every, "smape", {"m": 0.5}, ("strategy",)).select("strategy", F.round("m", 4).alias("median_smape"))
    share = lambda k: F.round(F.avg((F.col("smape") <= k).cast("int")) * 100, 4).alias(f"within_{k}")
    stats = every.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("smape"), 4).alias("mean_smape"), share(10), share(25), F.round((F.sum("predicted") / F.sum("actual") - 1) * 100, 4).alias("bias"))
    return stats.join(q, "strategy")


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, _walked_sql(VALID, 2), _ADAPTIVE_SQL, _BOARD_SQL, _STRATEGY_SQL) + """SELECT strategy, count(*) AS n, round(avg(smape), 4) AS mean_smape, round(median(smape), 4) AS median_smape,
  round(avg(CAST(smape <= 10 AS INT)) * 100, 4) AS within_10, round(avg(CAST(smape <= 25 AS INT)) * 100, 4) AS within_25, round((sum(predicted) / sum(actual) - 1) * 100, 4) AS bias FROM ss GROUP BY 1""")
def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method and every strategy over them scored on the target year; all of them read predictions that are written once."""
    return strategy_board(strategies(board(spark, sf_dir)))


@query()
def strategy_scores_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same board with the fitted contestants: each series' ridge and the boosted model, for series with three earlier years."""
    rows = walk(spark, sf_dir, (TARGET,), 3)
    panel = written_once(fine(spark, sf_dir, until=TARGET + 1).select("series_key", "year", F.col("committed").alias("value")), "panel")
    fitted = long_predictions(rows, ("Ridge", "Boosting"), ["series_key", "year", "actual"], panel, (TARGET,)).select("actual", F.col("method").alias("strategy"), "predicted")
    return strategy_board(strategies(board(spark, sf_dir)).unionByName(fitted))
