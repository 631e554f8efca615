"""Chart aggregates, label maps and overviews of the report pages, and the model comparisons behind them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learners as L
from ..operators import series as S
from ..operators import windows as O
from ..operators.boosting import Fit, fit_all
from ..sources import cells as C
from ..sources.panels import TARGET, annual, fine, rate, table
from ..sources.shared import written_once
from .anomalies import SCORE_SQL, SIGNALS, _TOP_SQL, benford, benford_sql, votes
from .base_sql import ANNUAL, FINE, MOVES, QUARTERS, with_
from .cleaning import _DEPTH, _RECORDS, records
from .features import WIDE_SQL, wide
from .forecasts import CREDITS_SQL, HIST, RECENT_SQL, exec_rate, history, target
from .learning import FEATURES, QUARTERLY_SQL, linear_sql, quarterly
from .registry import query
from .selection import walk_sql

r4 = lambda c: F.round(c, 4)


# --- cleaning ----------------------------------------------------------------------------------------
@query(with_(ANNUAL, _RECORDS) + f"SELECT year, i AS record, d AS code, h AS label, k AS opened FROM recs WHERE {_DEPTH} = 3")
def level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one level of the hierarchy, the lines."""
    level = F.element_at(F.array(*map(F.lit, ("chapter", "programme", "line"))), C.depth(["b", "c", "d"]))
    return records(spark, sf_dir).where(level == "line").select("year", F.col("i").alias("record"), F.col("d").alias("code"), F.col("h").alias("label"), F.col("k").alias("opened"))


@query(with_(MOVES, *benford_sql()) + "SELECT l1, n, coalesce(chi2, (SELECT median(chi2) FROM ben), 0) AS chi2 FROM ben")
def benford_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from Benford's law by chapter; the chapters' median where a chapter has too few digits, 0 where all have."""
    df = benford(spark, sf_dir)
    return df.crossJoin(F.broadcast(O.quantiles(df, "chi2", {"m": 0.5}))).select("l1", "n", F.coalesce("chi2", "m", F.lit(0.0)).alias("chi2"))


# --- aggregates behind the charts ------------------------------------------------------------------------
_YEARS = tuple(range(TARGET - 4, TARGET + 1))


@query(with_(FINE) + "SELECT l1, " + ", ".join(f"round(avg(rate) FILTER (year = {y}), 6) AS y{y}" for y in _YEARS) + " FROM fine GROUP BY 1")
def rate_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rate of each chapter and year as a matrix, from one aggregation."""
    at = lambda y: F.round(F.avg(F.when(F.col("year") == y, F.col("rate"))), 6).alias(f"y{y}")
    return fine(spark, sf_dir, _YEARS[0], TARGET + 1).groupBy("l1").agg(*map(at, _YEARS))


@query(with_(FINE, walk_sql(), SCORE_SQL, _TOP_SQL) + f"SELECT region, count(*) AS n FROM (SELECT concat_ws('+', {', '.join(f'''CASE WHEN {s}_top THEN '{s}' END''' for s in SIGNALS)}) AS region FROM votes) WHERE region <> '' GROUP BY 1")
def signal_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each region of the Venn diagram of three signals: flagged by exactly these."""
    region = F.concat_ws("+", *[F.when(F.col(f"{s}_top"), F.lit(s)) for s in SIGNALS])
    return votes(spark, sf_dir).groupBy(region.alias("region")).agg(F.count("*").alias("n")).where("region <> ''")


@query(with_(FINE) + f"SELECT l1, CAST(floor(log10(opened) * 4) AS BIGINT) AS size_bin, CAST(floor(round(rate, 6) * 20) AS BIGINT) AS rate_bin, count(*) AS n FROM (SELECT l1, round(opened, 2) AS opened, rate FROM fine WHERE year = {TARGET} AND rate IS NOT NULL) GROUP BY 1, 2, 3")
def scatter_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the scatter of size and rate by chapter, counted in cells: a picture's worth of rows at any scale."""
    df = fine(spark, sf_dir, TARGET, TARGET + 1).where(F.col("rate").isNotNull())
    return df.groupBy("l1", F.floor(F.log10(F.round("opened", 2)) * 4).alias("size_bin"), F.floor(F.round("rate", 6) * 20).alias("rate_bin")).agg(F.count("*").alias("n"))


# --- payloads and overviews ------------------------------------------------------------------------------
@query("SELECT DISTINCT 'chapter' AS kind, p_type AS code, min(p_name) OVER (PARTITION BY p_type) AS label FROM part UNION ALL SELECT 'programme', CAST(s_suppkey AS VARCHAR), trim(s_name) FROM supplier")
def manager_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps of the manager's payload: the first label of each chapter, the label of each programme."""
    chapters = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_name").alias("label")).select(F.lit("chapter").alias("kind"), F.col("p_type").alias("code"), "label")
    return chapters.unionByName(table(spark, sf_dir, "supplier").select(F.lit("programme").alias("kind"), F.col("s_suppkey").cast("string").alias("code"), F.trim("s_name").alias("label")))


@query(with_(FINE, HIST) + f"""SELECT count(*) AS lines, round(sum(p), 3) AS predicted, round(sum(c), 4) AS credits, round(sum(p) / sum(c), 6) AS global_rate, round(sum(last), 4) AS last_total, round((sum(p) / sum(last) - 1) * 100, 4) AS change_pct
FROM (SELECT {RECENT_SQL} * {CREDITS_SQL} AS p, {CREDITS_SQL} AS c, h[len(h)] AS last FROM hist LEFT JOIN target USING (series_key)) WHERE p IS NOT NULL""")
def known_credits_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the forecast from known credits: amount, credits, implied rate, and change on the last year."""
    h = history(spark, sf_dir).join(target(spark, sf_dir), "series_key", "left")
    last = S.last(F.col("h"))
    known = F.coalesce(F.when(F.col("credits") > 0, F.col("credits")), F.when(S.last(F.col("cs")) > 0, S.last(F.col("cs"))))
    df = h.select(exec_rate(h).alias("p"), known.alias("c"), last.alias("last")).where("p IS NOT NULL")
    return df.agg(F.count("*").alias("lines"), F.round(F.sum("p"), 3).alias("predicted"), r4(F.sum("c")).alias("credits"), F.round(F.sum("p") / F.sum("c"), 6).alias("global_rate"), r4(F.sum("last")).alias("last_total"), r4((F.sum("p") / F.sum("last") - 1) * 100).alias("change_pct"))


@query(with_(QUARTERS, WIDE_SQL) + f""", b AS (SELECT series_key, avg(t4 - t2) AS gain FROM wide WHERE year < {TARGET} GROUP BY 1)
SELECT category, count(*) AS lines, round(avg(t2 + gain), 6) AS mean_predicted, round(avg(t4), 6) AS mean_actual, round(avg(abs(t4 - t2 - gain)), 6) AS mean_error, round(sum(annual), 4) AS total
FROM wide JOIN b USING (series_key) WHERE year = {TARGET} GROUP BY 1""")
def overview_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean predicted and actual year-end rate by category, with the mean error and the amount behind them."""
    w = wide(spark, sf_dir)
    b = w.where(F.col("year") < TARGET).groupBy("series_key").agg(F.avg(F.col("t4") - F.col("t2")).alias("gain"))
    p = F.col("t2") + F.col("gain")
    return w.where(F.col("year") == TARGET).join(b, "series_key").groupBy("category").agg(F.count("*").alias("lines"), F.round(F.avg(p), 6).alias("mean_predicted"), F.round(F.avg("t4"), 6).alias("mean_actual"), F.round(F.avg(F.abs(F.col("t4") - F.col("t2") - F.col("gain"))), 6).alias("mean_error"), r4(F.sum("annual")).alias("total"))


@query(with_(ANNUAL) + "SELECT l1, count(DISTINCT l2) AS programmes, " + ", ".join(f"round(sum(committed) FILTER (year = {y}) / nullif(sum(opened) FILTER (year = {y}), 0), 6) AS rate_{y}" for y in _YEARS) + " FROM annual GROUP BY 1")
def overview_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rate of each year side by side, and the number of programmes, by chapter."""
    at = lambda y, c: F.sum(F.when(F.col("year") == y, F.col(c)))
    return annual(spark, sf_dir).groupBy("l1").agg(F.countDistinct("l2").alias("programmes"), *[F.round(at(y, "committed") / F.nullif(at(y, "opened"), F.lit(0.0)), 6).alias(f"rate_{y}") for y in _YEARS])


# --- models ------------------------------------------------------------------------------------------
def robust_ridge(train: DataFrame, test: DataFrame, features: list[str], alpha: float) -> DataFrame:
    """test with column prediction: ridge with penalty alpha (on the sum of squares) over features scaled by exact median and quartile distance.

    All quartiles come from one pass over the unpivoted features; one row of them is broadcast.
    """
    long = train.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features])).alias("r")).select("r.*")
    q = O.quantiles(long, "v", {"lo": 0.25, "med": 0.5, "hi": 0.75}, ("f",))
    at = lambda f, c: F.max(F.when(F.col("f") == f, c))
    one = F.broadcast(q.agg(*[at(f, F.col("med")).alias(f"_m_{f}") for f in features], *[at(f, F.col("hi") - F.col("lo")).alias(f"_s_{f}") for f in features]))
    scaled = lambda df: df.crossJoin(one).withColumns({f"_c_{f}": F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")) for f in features})
    size = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    fit = LinearRegression(featuresCol="_x", labelCol="label", regParam=alpha * (size.s or 0.0) / max(size.n, 1), standardization=False)
    model = Pipeline(stages=[VectorAssembler(inputCols=[f"_c_{f}" for f in features], outputCol="_x", handleInvalid="skip"), fit]).fit(scaled(train))
    return model.transform(scaled(test)).select(*test.columns, "prediction")


def _robust_sql(features: list[str], alpha: float) -> str:
    cuts = ", ".join(f"median({f}) AS m_{f}, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS s_{f}" for f in features)
    scaled = ", ".join(f"({f} - m_{f}) / s_{f} AS c_{f}" for f in features)
    return f"""rcut AS (SELECT {cuts} FROM train), rtrain AS (SELECT *, {scaled} FROM train, rcut), rtest AS (SELECT *, {scaled} FROM test, rcut),
{linear_sql('robust', 'rtrain', 'rtest', [f'c_{f}' for f in features], 't4', alpha, scale=False)}"""


ALPHA = 0.5


@query(with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL, _robust_sql(FEATURES, ALPHA)) + "SELECT series_key, round(t4, 6) AS actual, round(p, 6) AS predicted FROM robust")
def model_robust_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-end rate by ridge (penalty 0.5) over robustly scaled features."""
    df = quarterly(spark, sf_dir)
    out = robust_ridge(df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET), FEATURES, ALPHA)
    return out.select("series_key", F.round("label", 6).alias("actual"), F.round("prediction", 6).alias("predicted"))


BASE = ["t1", "t2"]
#: Upper bounds of the error classes; what is above the last is "over".
CLASSES = {"under_05": 0.05, "to_10": 0.10, "to_15": 0.15}


def compare_models(predictions: dict[str, DataFrame]) -> DataFrame:
    """model, n, mae, rmse, gain_pct (of rmse against the first model) and the number of errors in each class. Each frame has label and prediction, cut to 0..1.3."""
    first, long = next(iter(predictions)), None
    for name, df in predictions.items():
        part = df.select(F.lit(name).alias("model"), F.round(F.abs(F.col("label") - S.clip(F.col("prediction"), 0, 1.3)), 9).alias("e"))
        long = part if long is None else long.unionByName(part)
    low, counts = F.lit(-1.0), []
    for name, high in CLASSES.items():
        counts.append(F.count_if((F.col("e") >= low) & (F.col("e") < high)).alias(name))
        low = F.lit(high)
    out = long.groupBy("model").agg(F.count("*").alias("n"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), *counts, F.count_if(F.col("e") >= low).alias("over"))
    base = F.broadcast(out.where(F.col("model") == first).select(F.col("rmse").alias("base")))
    return out.crossJoin(base).select("model", "n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round((1 - F.col("rmse") / F.col("base")) * 100, 3).alias("gain_pct"), *CLASSES, "over")


def _compare_sql(models: dict[str, str]) -> str:
    low, counts = "-1", []
    for name, high in CLASSES.items():
        counts.append(f"count(*) FILTER (e >= {low} AND e < {high}) AS {name}")
        low = str(high)
    rows = " UNION ALL ".join(f"SELECT '{k}' AS model, round(abs(t4 - least(greatest(p, 0), 1.3)), 9) AS e FROM {v}" for k, v in models.items())
    return f""", cmp AS (SELECT model, count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, {', '.join(counts)}, count(*) FILTER (e >= {low}) AS over FROM ({rows}) GROUP BY 1)
SELECT model, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round((1 - rmse / (SELECT rmse FROM cmp WHERE model = '{next(iter(models))}')) * 100, 3) AS gain_pct, {', '.join(CLASSES)}, over FROM cmp"""


@query(with_(QUARTERS, WIDE_SQL, QUARTERLY_SQL, linear_sql("base", "train", "test", BASE, "t4"), _robust_sql(FEATURES, ALPHA)) + _compare_sql({"base": "base", "improved": "robust"}))
def model_ab_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features against improved ones on one hold-out: errors, gain of the second and the distribution over error classes."""
    df = quarterly(spark, sf_dir)
    train, test = df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET)
    return compare_models({"base": L.estimator("linear", BASE).fit(train).transform(test), "improved": robust_ridge(train, test, FEATURES, ALPHA)})


@query()
def boosting_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parameter sets of boosting on one hold-out, at all their rounds, trained side by side."""
    df = quarterly(spark, sf_dir)
    test = df.where(F.col("year") == TARGET)
    fits = fit_all(df, {k: Fit(tuple(FEATURES), where=F.col("year") < TARGET, how=L.BOOSTED[k]) for k in ("selection", "leafwise", "alerts", "backtest")}, ["series_key", "year"])
    return compare_models({k: f.transform(test) for k, f in fits.items()})


#: Isolation forests of the reports: trees and share of rows flagged (fixed values); None follows the share of series that rules flag, within 0.02 and 0.12.
FORESTS = {"extended": (300, 0.05), "pipeline": (200, 0.05), "adaptive": (200, None), "risk": (200, 0.10)}


def flagged_share(found: Column, series: Column) -> Column:
    """Share of series with a rule's flag, within 0.02 and 0.12."""
    return F.greatest(F.lit(0.02), F.least(F.lit(0.12), F.try_divide(found, series)))


@query()
def isolation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows flagged by each of four isolation forests, the share used, and their agreement with the rule of rates above 1.1 times the series' mean."""
    from ..operators.outliers import isolation_forests

    df = fine(spark, sf_dir, until=TARGET).select("series_key", "year", F.coalesce("rate", F.lit(0.0)).alias("rate"), (F.col("opened") / 1e6).alias("size"))
    df = O.with_group(df, ["series_key"], F.avg("rate").alias("usual")).withColumn("rule", F.col("rate") > 1.1 * F.col("usual"))
    series = df.groupBy("series_key").agg(F.max("rule").alias("rule")).agg(flagged_share(F.count_if("rule"), F.count("*")).alias("share"))
    scored = written_once(isolation_forests(df, ["rate", "size"], {k: n for k, (n, _) in FORESTS.items()}, seed=42).select("rule", *FORESTS), "forests")
    long = scored.select("rule", F.explode(F.array(*[F.struct(F.lit(k).alias("forest"), F.col(k).alias("v")) for k in FORESTS])).alias("r")).select("rule", "r.*")
    # whole percents, so one row of quantiles a forest serves any share
    cuts = O.quantiles(long, "v", {f"p{i}": 1 - i / 100 for i in range(2, 13)}, ("forest",))
    asked = F.coalesce(*[F.when(F.col("forest") == k, F.lit(share)) for k, (_, share) in FORESTS.items() if share], F.col("share"))
    cuts = cuts.crossJoin(F.broadcast(series)).withColumn("share", F.round(asked, 2))
    cuts = cuts.select("forest", "share", F.coalesce(*[F.when(F.round(F.col("share") * 100) == i, F.col(f"p{i}")) for i in range(2, 13)]).alias("cut"))
    f = long.join(F.broadcast(cuts), "forest").withColumn("f", F.col("v") >= F.col("cut"))  # a row a forest
    out = f.groupBy("forest", "share").agg(F.count_if("f").alias("flagged"), F.count("*").alias("n"), F.round(F.try_divide(F.count_if(F.col("f") & F.col("rule")), F.count_if(F.col("f") | F.col("rule"))), 6).alias("jaccard"))
    trees = F.coalesce(*[F.when(F.col("forest") == k, F.lit(n)) for k, (n, _) in FORESTS.items()])
    return out.select("forest", trees.alias("trees"), "share", "flagged", "n", "jaccard")


@query()
def two_stage_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error of the direct and the rolling forecast of the year's end for linear, ridge, forest and boosting: the rolling one learns from actual third quarters and is applied to predicted ones."""
    df = quarterly(spark, sf_dir)
    train, test = df.where(F.col("year") < TARGET), df.where(F.col("year") == TARGET)
    late = ["t2", "t3", "prev"]
    own = lambda label, features=FEATURES: Fit(tuple(features), label, F.col("year") < TARGET, L.BOOSTED["selection"])
    boosted = fit_all(df, {"direct": own("label"), "third": own("t3"), "last": own("label", late)}, ["series_key", "year"])
    out = None
    for name in ("linear", "ridge", "forest", "boosting"):
        if name == "boosting":
            direct, third, last = (boosted[k] for k in ("direct", "third", "last"))
        else:
            direct = L.estimator(name, FEATURES).fit(train)
            third = L.estimator(name, FEATURES).fit(train.withColumn("label", F.col("t3")))
            last = L.estimator(name, late).fit(train)
        one = direct.transform(test).withColumnRenamed("prediction", "direct").drop("features", "raw")
        both = last.transform(third.transform(one).withColumn("t3", F.col("prediction")).drop("prediction", "features", "raw"))
        e = lambda c: F.round(F.avg(F.abs(F.col("label") - F.col(c))), 6)
        part = both.agg(F.count("*").alias("n"), e("direct").alias("direct"), e("prediction").alias("rolling")).select(F.lit(name).alias("model"), "n", "direct", "rolling")
        out = part if out is None else out.unionByName(part)
    return out
