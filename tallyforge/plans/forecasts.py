"""Forecast queries: one-step methods, rates, intervals, horizons. The held-out year is TARGET; earlier years train."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import series as S
from ..settings import HORIZON
from ..sources.panels import TARGET, annual, fine
from .base_sql import ANNUAL, FINE, with_
from .registry import query

# --- SQL of the methods over a list h ------------------------------------------------------------
_N = "len(h)"
_LAST = f"h[{_N}]"
_MEAN = "list_avg({h})"
_TAIL3 = f"h[greatest({_N} - 2, 1):{_N}]"


def trend_sql(h: str = "h") -> str:
    n = f"len({h})"
    return f"(CASE WHEN {n} < 2 THEN {h}[{n}] ELSE list_avg({h}) + list_sum(list_transform(range(1, {n} + 1), lambda i: (i - ({n} + 1) / 2.0) * {h}[i])) / ({n} * ({n} * {n} - 1) / 12.0) * ({n} + 1) / 2.0 END)"


def level_sql(h: str, a: float) -> str:
    return f"list_reduce({h}[2:len({h})], lambda l, x: {a} * x + {round(1 - a, 1)} * l, {h}[1])"


_SES = f"(CASE WHEN {_N} < 3 THEN {level_sql('h', 0.5)} ELSE list_sort([{', '.join(f'''{{'e': pow({level_sql(f'h[1:{_N} - 1]', a)} - {_LAST}, 2), 'i': {i}, 'f': {level_sql('h', a)}}}''' for i, a in enumerate(S.ALPHAS))}])[1].f END)"


def damped_sql(h: str, a: float, b: float, p: float) -> str:
    step = f"{{'l': {a} * x.l + {1 - a} * (s.l + {p} * s.t), 't': {b} * ({a} * x.l + {1 - a} * (s.l + {p} * s.t) - s.l) + {1 - b} * {p} * s.t}}"
    run = f"list_reduce(list_transform({h}[2:len({h})], lambda v: {{'l': v, 't': CAST(0 AS DOUBLE)}}), lambda s, x: {step}, {{'l': {h}[1], 't': {h}[2] - {h}[1]}})"
    return f"({run}.l + {p} * {run}.t)"


_DAMPED = f"(CASE WHEN {_N} < 3 THEN {trend_sql()} WHEN {_N} = 3 THEN {damped_sql('h', 0.6, 0.3, 0.9)} ELSE list_sort([{', '.join(f'''{{'e': pow({damped_sql(f'h[1:{_N} - 1]', *x)} - {_LAST}, 2), 'i': {i}, 'f': {damped_sql('h', *x)}}}''' for i, x in enumerate(S.DAMPED))}])[1].f END)"
_DEV = f"list_median(list_transform({_TAIL3}, lambda x: abs(x - list_median({_TAIL3}))))"
_KEEP = f"list_filter({_TAIL3}, lambda x: abs(x - list_median({_TAIL3})) <= 3 * (CASE WHEN {_DEV} = 0 THEN 1 ELSE {_DEV} END))"
METHOD_SQL = {
    "DampedTrend": _DAMPED,
    "LogTrend": f"(CASE WHEN len(list_filter(h, lambda x: x <= 0)) > 0 OR {_N} < 2 THEN {trend_sql()} ELSE exp({trend_sql('list_transform(h, lambda x: ln(greatest(x, 1e-300)))')}) END)",
    "Mean3": f"list_avg({_TAIL3})",
    "Median": "list_median(h)",
    "Naive": _LAST,
    "RobustMean": f"(CASE WHEN len({_KEEP}) > 0 THEN list_avg({_KEEP}) ELSE list_median({_TAIL3}) END)",
    "SES": _SES,
    "Theta": f"(CASE WHEN {_N} < 2 THEN {_LAST} ELSE 0.5 * ({_SES} + {trend_sql()}) END)",
    "Trend": trend_sql(),
    "Weighted": f"(list_sum(list_transform(range(1, {_N} + 1), lambda i: h[i] * pow(0.7, {_N} - i))) / list_sum(list_transform(range(1, {_N} + 1), lambda i: pow(0.7, {_N} - i))))",
}
HIST = f"""hist AS (
  SELECT series_key, l1, list(committed ORDER BY year) AS h, list(year ORDER BY year) AS ys, list(opened ORDER BY year) AS cs, list(rate ORDER BY year) FILTER (rate IS NOT NULL) AS rs
  FROM fine WHERE year < {TARGET} GROUP BY 1, 2 HAVING count(*) >= 3),
target AS (SELECT series_key, committed AS actual, opened AS credits FROM fine WHERE year = {TARGET})"""
SMAPE = "CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 100 * abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2) END"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_key, l1, years, h (committed), cs (opened), rs (known rates) before the target year, of series with three years or more."""
    df = fine(spark, sf_dir, until=TARGET)
    out = S.collapse(df, ["series_key"], "year", "committed", "opened", "rate", keep=("l1",)).where(F.size("years") >= 3)
    return out.select("series_key", "l1", "years", F.col("committeds").alias("h"), F.col("openeds").alias("cs"), F.filter("rates", lambda r: r.isNotNull()).alias("rs"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fine(spark, sf_dir, TARGET, TARGET + 1).select("series_key", F.col("committed").alias("actual"), F.col("opened").alias("credits"))


def _one_step(method: str) -> None:
    digits = 3 if method in ("Theta", "SES", "DampedTrend") else 5  # so that no exact tie of the rounding is likely

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return history(spark, sf_dir).select("series_key", F.round(S.METHODS[method](F.col("h")), digits).alias("predicted"))

    run.__doc__ = f"Forecast of the target year by {method}."
    short = {"DampedTrend": "damped", "LogTrend": "logtrend", "RobustMean": "robust"}.get(method, method.lower())
    query(with_(FINE, HIST) + f"SELECT series_key, round({METHOD_SQL[method]}, {digits}) AS predicted FROM hist", f"forecast_{short}")(run)


for _m in S.METHODS:
    _one_step(_m)


@query(with_(FINE, HIST) + f"""SELECT series_key, round(greatest(0, regr_intercept(v, y - 2000) + regr_slope(v, y - 2000) * ({TARGET} - 2000)), 5) AS predicted
FROM (SELECT series_key, unnest(h) AS v, unnest(ys) AS y FROM hist) GROUP BY 1""")
def forecast_trend_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend over the years themselves, floored at 0 (gaps in the years count)."""
    return history(spark, sf_dir).select("series_key", F.round(S.trend_years(F.col("h"), F.col("years"), TARGET), 5).alias("predicted"))


GROWTH_SQL = f"""growth AS (
  SELECT least(greatest(CASE WHEN b > 0 THEN a / b ELSE 1 END, 0.5), 2.0) AS g FROM (
    SELECT round(sum(committed) FILTER (year = {TARGET - 1}), 4) AS a, round(sum(committed) FILTER (year = {TARGET - 2}), 4) AS b FROM fine))"""


def growth(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One row: clipped growth of the total over the last two training years. rows: a panel with these years that a plan reads anyway."""
    at = lambda y: F.round(F.sum(F.when(F.col("year") == y, F.col("committed"))), 4)
    rows = fine(spark, sf_dir, TARGET - 2, TARGET) if rows is None else rows
    return rows.agg(at(TARGET - 1).alias("a"), at(TARGET - 2).alias("b")).select(S.clip(F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.lit(1.0)), 0.5, 2.0).alias("g"))


@query(with_(FINE, HIST, GROWTH_SQL) + f"SELECT series_key, round({_LAST} * g, 5) AS predicted FROM hist, growth")
def forecast_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value times the growth of the total. The growth is one row, so its broadcast has a fixed size."""
    return history(spark, sf_dir).crossJoin(F.broadcast(growth(spark, sf_dir))).select("series_key", F.round(S.last(F.col("h")) * F.col("g"), 5).alias("predicted"))


RECENT_SQL = "(CASE WHEN len(rs) >= 3 THEN list_median(rs[len(rs) - 2:len(rs)]) WHEN len(rs) > 0 THEN list_avg(rs) END)"
CREDITS_SQL = "coalesce(CASE WHEN credits > 0 THEN credits END, CASE WHEN cs[len(cs)] > 0 THEN cs[len(cs)] END)"


def exec_rate(h: DataFrame) -> Column:
    """Recent rate times the target year's credits, or the last known ones."""
    credits_ = F.coalesce(F.when(F.col("credits") > 0, F.col("credits")), F.when(S.last(F.col("cs")) > 0, S.last(F.col("cs"))))
    return S.recent_rate(F.col("rs")) * credits_


@query(with_(FINE, HIST) + f"SELECT series_key, round({RECENT_SQL} * {CREDITS_SQL}, 5) AS predicted FROM hist LEFT JOIN target USING (series_key)")
def forecast_execrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution rate times known credits."""
    h = history(spark, sf_dir).join(target(spark, sf_dir), "series_key", "left")
    return h.select("series_key", F.round(exec_rate(h), 5).alias("predicted"))


@query(with_(FINE, HIST, f"bottom AS (SELECT series_key, l1, {_LAST} AS p FROM hist)", f"""tops AS (
  SELECT l1, list(s ORDER BY year) AS h FROM (SELECT l1, year, round(sum(committed), 4) AS s FROM fine WHERE year < {TARGET} GROUP BY 1, 2) GROUP BY 1)""", f"""scaled AS (
  SELECT l1, CASE WHEN s > 0 AND t > 0 THEN least(greatest(t / s, 0.7), 1.4) ELSE 1 END AS k
  FROM (SELECT l1, {METHOD_SQL['Theta']} AS t FROM tops) JOIN (SELECT l1, round(sum(p), 4) AS s FROM bottom GROUP BY 1) USING (l1))""") + "SELECT series_key, round(p * k, 5) AS predicted FROM bottom JOIN scaled USING (l1)")
def forecast_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive forecasts scaled so that each chapter meets its own Theta forecast, within 0.7 to 1.4."""
    bottom = history(spark, sf_dir).select("series_key", "l1", S.last(F.col("h")).alias("p"))
    totals = fine(spark, sf_dir, until=TARGET).groupBy("l1", "year").agg(F.round(F.sum("committed"), 4).alias("s"))
    tops = S.collapse(totals, ["l1"], "year", "s").select("l1", S.theta(F.col("ss")).alias("t"))
    sums = bottom.groupBy("l1").agg(F.round(F.sum("p"), 4).alias("s"))
    k = F.when((F.col("s") > 0) & (F.col("t") > 0), S.clip(F.col("t") / F.nullif(F.col("s"), F.lit(0.0)), 0.7, 1.4)).otherwise(F.lit(1.0))
    return bottom.join(tops.join(sums, "l1").select("l1", k.alias("k")), "l1").select("series_key", F.round(F.col("p") * F.col("k"), 5).alias("predicted"))


_RATE_SQL = {"RateLast": "rs[len(rs)]", "RateMean": "list_avg(rs)", "RateMed": "list_median(rs)", "RateTrend": f"least(greatest({trend_sql('rs')}, 0), 2)"}


@query(with_(FINE, HIST) + f"SELECT series_key, {', '.join(f'round({v}, 6) AS {k}' for k, v in _RATE_SQL.items())} FROM hist WHERE len(rs) > 0")
def rate_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rate forecasts: last, mean, median and trend within 0 to 2."""
    r = F.col("rs")
    return history(spark, sf_dir).where(F.size("rs") > 0).select("series_key", *[F.round(x, 6).alias(k) for k, x in {"RateLast": S.last(r), "RateMean": S.mean(r), "RateMed": S.median(r), "RateTrend": S.clip(S.trend(r), 0, 2)}.items()])


@query(with_(FINE, HIST) + "SELECT series_key, round(list_median(rs) * credits, 5) AS status_quo, round(list_median(rs) * credits * 0.9, 5) AS cut, round(list_median(rs) * credits * 1.1, 5) AS rise FROM hist JOIN target USING (series_key) WHERE len(rs) > 0")
def rate_x_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median rate times the credits of three scenarios."""
    p = S.median(F.col("rs")) * F.col("credits")
    h = history(spark, sf_dir).where(F.size("rs") > 0).join(target(spark, sf_dir), "series_key")
    return h.select("series_key", F.round(p, 5).alias("status_quo"), F.round(p * 0.9, 5).alias("cut"), F.round(p * 1.1, 5).alias("rise"))


@query(with_(FINE, HIST) + f"SELECT series_key, round(least(greatest({RECENT_SQL}, 0), 1.2), 6) AS taux, round(credits, 5) AS credits, round(credits * least(greatest({RECENT_SQL}, 0), 1.2), 5) AS predicted FROM hist JOIN target USING (series_key) WHERE len(rs) > 0")
def forecast_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known credits times the recent rate within 0 to 1.2."""
    r = S.clip(S.clip(S.recent_rate(F.col("rs")), 0, 2), 0, 1.2)
    h = history(spark, sf_dir).where(F.size("rs") > 0).join(target(spark, sf_dir), "series_key")
    return h.select("series_key", F.round(r, 6).alias("taux"), F.round("credits", 5).alias("credits"), F.round(F.col("credits") * r, 5).alias("predicted"))


def rate_models(r: Column) -> dict[str, Column]:
    """The closed-form rate models within 0 to 1, in the order that breaks ties."""
    n = F.size(r)
    ramp = S.total(F.transform(r, lambda x, i: x * (i + 1))) / (n * (n + 1) / 2)
    return {"linear": S.clip(S.trend(r), 0, 1), "average": S.clip(S.mean(r), 0, 1), "weighted": S.clip(ramp, 0, 1), "naive": S.clip(S.last(r), 0, 1), "ses": S.clip(S._level(r, 0.5), 0, 1)}


RATE_MODEL_SQL = {
    "linear": f"least(greatest({trend_sql('rs')}, 0), 1)",
    "average": "least(greatest(list_avg(rs), 0), 1)",
    "weighted": "least(greatest(list_sum(list_transform(range(1, len(rs) + 1), lambda i: rs[i] * i)) / (len(rs) * (len(rs) + 1) / 2.0), 0), 1)",
    "naive": "least(greatest(rs[len(rs)], 0), 1)",
    "ses": f"least(greatest({level_sql('rs', 0.5)}, 0), 1)",
}


@query(with_(FINE, HIST) + f"SELECT series_key, {', '.join(f'round({v}, 6) AS {k}' for k, v in RATE_MODEL_SQL.items())} FROM hist WHERE len(rs) > 0")
def forecast_rate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rate models within 0 to 1 (exponential smoothing with alpha one half)."""
    return history(spark, sf_dir).where(F.size("rs") > 0).select("series_key", *[F.round(x, 6).alias(k) for k, x in rate_models(F.col("rs")).items()])


_FIT_STATE = "{{'m': {m}, 'w': {w}, 'xy': {xy}, 'ww': {ww}, 'yy': {yy}}}"
_FIT_STEP = _FIT_STATE.format(m="alpha * x.m + (1 - alpha) * s.m", w="s.w * (1 - alpha)", xy="s.xy + s.w * (x.m - s.m)", ww="s.ww + s.w * s.w", yy="s.yy + (x.m - s.m) * (x.m - s.m)")
_FIT_SQL = f"""fits AS (SELECT series_key, alpha, list_reduce(list_transform(rs, lambda v: {_FIT_STATE.format(m='v', w='0.0::DOUBLE', xy='0.0::DOUBLE', ww='0.0::DOUBLE', yy='0.0::DOUBLE')}), lambda s, x: {_FIT_STEP},
    {_FIT_STATE.format(m='0.0::DOUBLE', w='1.0::DOUBLE', xy='0.0::DOUBLE', ww='0.0::DOUBLE', yy='0.0::DOUBLE')}) AS s
  FROM (SELECT series_key, rs, CAST(unnest(range(1, 51)) * 2 / 100.0 AS DOUBLE) AS alpha FROM hist WHERE len(rs) > 1)),
least_error AS (SELECT series_key, alpha, f, row_number() OVER (PARTITION BY series_key ORDER BY e, alpha) AS rn FROM (SELECT series_key, alpha, round(s.yy - s.xy * s.xy / s.ww, 9) AS e, s.m + s.w * s.xy / s.ww AS f FROM fits))"""


@query(with_(FINE, HIST, _FIT_SQL) + "SELECT series_key, round(alpha, 2) AS alpha, round(least(greatest(f, 0), 1), 6) AS predicted FROM least_error WHERE rn = 1")
def forecast_ses_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing of rates with alpha and first level fitted: for each alpha of a fine grid the best level has a closed form; the first alpha on ties (nine decimals)."""

    def fit(r: Column, a: float) -> Column:
        # the one-step error at place i is e_i - w_i * l0, linear in the first level l0
        step = lambda s, x: F.struct((a * x + (1 - a) * s["m"]).alias("m"), (s["w"] * (1 - a)).alias("w"), (s["xy"] + s["w"] * (x - s["m"])).alias("xy"), (s["ww"] + s["w"] * s["w"]).alias("ww"), (s["yy"] + (x - s["m"]) * (x - s["m"])).alias("yy"))
        start = F.struct(*[F.lit(v).alias(k) for k, v in (("m", 0.0), ("w", 1.0), ("xy", 0.0), ("ww", 0.0), ("yy", 0.0))])
        return F.aggregate(r, start, step, lambda s: F.struct(F.round(s["yy"] - s["xy"] * s["xy"] / s["ww"], 9).alias("e"), F.lit(a).alias("alpha"), (s["m"] + s["w"] * s["xy"] / s["ww"]).alias("f")))

    grid = [round(0.02 * i, 2) for i in range(1, 51)]
    best = F.array_min(F.array(*[fit(F.col("rs"), a) for a in grid]))
    return history(spark, sf_dir).where(F.size("rs") > 1).select("series_key", best.alias("b")).select("series_key", F.round("b.alpha", 2).alias("alpha"), F.round(S.clip(F.col("b.f"), 0, 1), 6).alias("predicted"))


@query(with_(FINE, HIST, "cr AS (SELECT series_key, cs AS h FROM hist)") + f"SELECT series_key, round(greatest(0, {trend_sql()}), 5) AS credits FROM cr")
def forecast_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits by a straight line, floored at 0."""
    return history(spark, sf_dir).select("series_key", F.round(F.greatest(F.lit(0.0), S.trend(F.col("cs"))), 5).alias("credits"))


_BAND_SQL = f"""band AS (
  SELECT series_key, l1, count(*) AS n, regr_intercept(v, y - 2000) + regr_slope(v, y - 2000) * ({TARGET} - 2000) AS predicted,
    sqrt(greatest(regr_syy(v, y - 2000) - pow(regr_sxy(v, y - 2000), 2) / regr_sxx(v, y - 2000), 0) / greatest(count(*) - least(2, count(*) - 1), 1)) AS sigma
  FROM (SELECT l3 AS series_key, l1, opened AS v, year AS y FROM annual WHERE year < {TARGET}) GROUP BY 1, 2 HAVING count(*) >= 2)"""


def ols_band(df: DataFrame, key: list[str], value: str, year: str, at: int) -> DataFrame:
    """key, predicted and sigma at year `at` by a straight line; sigma from the residuals with min(2, n - 1) degrees less. Two years at least."""
    y, x, n = F.col(value), (F.col(year) - 2000).cast("double"), F.count("*")
    sse = F.greatest(F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2.0)) / F.regr_sxx(y, x), F.lit(0.0))
    out = df.groupBy(*key).agg(n.alias("n"), (F.regr_intercept(y, x) + F.regr_slope(y, x) * (at - 2000)).alias("predicted"), F.sqrt(sse / F.greatest(n - F.least(F.lit(2), n - 1), F.lit(1))).alias("sigma"))
    return out.where("n >= 2")


def _annual_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual(spark, sf_dir).where(F.col("year") < TARGET).withColumn("series_key", F.col("l3"))


@query(with_(ANNUAL, _BAND_SQL) + "SELECT series_key, round(predicted, 5) AS predicted, round(predicted - 2 * sigma, 5) AS lo, round(predicted + 2 * sigma, 5) AS hi FROM band", "ols_band")
def ols_band_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight line with a band of two residual deviations."""
    p, s = F.col("predicted"), F.col("sigma")
    return ols_band(_annual_train(spark, sf_dir), ["series_key"], "opened", "year", TARGET).select("series_key", F.round(p, 5).alias("predicted"), F.round(p - 2 * s, 5).alias("lo"), F.round(p + 2 * s, 5).alias("hi"))


def _line_sql(v: str) -> str:
    return f"regr_intercept({v}, year - 2000) + regr_slope({v}, year - 2000) * ({TARGET} - 2000)"


IDENTITY_SQL = f"""ident AS (
  SELECT l3 AS series_key, l1, greatest(0, {_line_sql('opened')}) AS o, greatest(0, {_line_sql('transfer_in')}) AS i, greatest(0, {_line_sql('transfer_out')}) AS t,
    least(greatest({_line_sql('committed / opened')}, 0), 1.3) AS r,
    sqrt(greatest(regr_syy(opened, year - 2000) - pow(regr_sxy(opened, year - 2000), 2) / regr_sxx(opened, year - 2000), 0) / greatest(count(*) - least(2, count(*) - 1), 1)) AS sigma
  FROM annual WHERE year < {TARGET} AND opened > 0 GROUP BY 1, 2 HAVING count(*) >= 2)"""


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast parts of the budget identity: o opened, i in, t out, r rate within 0 to 1.3, sigma of opened."""
    x = (F.col("year") - 2000).cast("double")
    line = lambda c: F.regr_intercept(c, x) + F.regr_slope(c, x) * (TARGET - 2000)
    o, n = F.col("opened"), F.count("*")
    sse = F.greatest(F.regr_syy(o, x) - F.pow(F.regr_sxy(o, x), F.lit(2.0)) / F.regr_sxx(o, x), F.lit(0.0))
    df = _annual_train(spark, sf_dir).where("opened > 0")
    floor = lambda c: F.greatest(F.lit(0.0), line(c))
    return df.groupBy("series_key", "l1").agg(n.alias("n"), floor(o).alias("o"), floor(F.col("transfer_in")).alias("i"), floor(F.col("transfer_out")).alias("t"), S.clip(line(F.col("committed") / o), 0, 1.3).alias("r"), F.sqrt(sse / F.greatest(n - F.least(F.lit(2), n - 1), F.lit(1))).alias("sigma")).where("n >= 2").drop("n")


@query(with_(ANNUAL, IDENTITY_SQL) + "SELECT series_key, round(o + i - t, 5) AS available, round(r, 6) AS taux, round(o * r, 5) AS committed, round(greatest(0, o - 2 * sigma) * r, 5) AS lo, round((o + 2 * sigma) * r, 5) AS hi FROM ident")
def budget_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """available = opened + in - out; committed = opened * rate, its band scaled from that of opened."""
    o, r, s = F.col("o"), F.col("r"), F.col("sigma")
    return identity(spark, sf_dir).select("series_key", F.round(o + F.col("i") - F.col("t"), 5).alias("available"), F.round(r, 6).alias("taux"), F.round(o * r, 5).alias("committed"), F.round(F.greatest(F.lit(0.0), o - 2 * s) * r, 5).alias("lo"), F.round((o + 2 * s) * r, 5).alias("hi"))


def _recursive_sql(method: str) -> str:
    more = ", ".join(f"[{i}.0]" for i in range(1, HORIZON + 1))  # a list for each step: its content is not looked at
    return f"list_reduce([h, {more}], lambda h, x: list_append(h, {METHOD_SQL[method]}))"


@query(with_(FINE, HIST, f"grown AS (SELECT series_key, len(h) AS n, {_recursive_sql('Naive')} AS a, {_recursive_sql('Mean3')} AS b, {_recursive_sql('Trend')} AS c FROM hist)") + """
SELECT series_key, CAST(step AS INT) AS step, round(a[n + step], 5) AS naive, round(b[n + step], 5) AS mean3, round(c[n + step], 5) AS trend FROM grown, (SELECT unnest(range(1, %d)) AS step)""" % (HORIZON + 1))
def recursive_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three years ahead, each forecast joining the history of the next."""
    h = F.col("h")
    three = history(spark, sf_dir).select("series_key", F.arrays_zip(*[S.recursive(h, f, HORIZON).alias(k) for k, f in (("naive", S.naive), ("mean3", S.mean3), ("trend", S.trend))]).alias("z"))
    return three.select("series_key", F.posexplode("z").alias("step", "z")).select("series_key", (F.col("step") + 1).cast("int").alias("step"), *[F.round(F.col("z")[k], 5).alias(k) for k in ("naive", "mean3", "trend")])


@query(with_(FINE, HIST) + f"""SELECT series_key, CAST(step AS INT) AS step, CAST({TARGET - 1} + step AS INT) AS year, round(r, 6) AS taux, round(cs[len(cs)], 5) AS credits,
  round(r * cs[len(cs)], 5) AS predicted, round(2 * s * abs(cs[len(cs)]) * sqrt(step), 5) AS half_width
FROM (SELECT series_key, cs, least(greatest(list_avg(rs), 0), 1) AS r, list_stddev_samp(rs) AS s FROM hist WHERE len(rs) >= 2), (SELECT unnest(range(1, {HORIZON + 1})) AS step)""")
def sigma_band_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct forecasts over three years; the band grows with the root of the horizon."""
    c = S.last(F.col("cs"))
    h = history(spark, sf_dir).where(F.size("rs") >= 2).select("series_key", c.alias("c"), S.clip(S.mean(F.col("rs")), 0, 1).alias("r"), S.stddev(F.col("rs"), 1).alias("s"))
    h = h.withColumn("step", F.explode(F.array(*map(F.lit, range(1, HORIZON + 1)))))
    return h.select("series_key", "step", (F.lit(TARGET - 1) + F.col("step")).cast("int").alias("year"), F.round("r", 6).alias("taux"), F.round("c", 5).alias("credits"), F.round(F.col("r") * F.col("c"), 5).alias("predicted"), F.round(2 * F.col("s") * F.abs("c") * F.sqrt("step"), 5).alias("half_width"))


@query(with_(FINE, f"means AS (SELECT l1, avg(rate) AS m FROM fine WHERE year < {TARGET} GROUP BY 1)", f"own AS (SELECT series_key, avg(rate) AS m FROM fine WHERE year < {TARGET} GROUP BY 1)") + f"""
SELECT series_key, round(coalesce(own.m, means.m), 6) AS hist_mean FROM fine LEFT JOIN own USING (series_key) LEFT JOIN means USING (l1) WHERE year = {TARGET}""")
def forecast_hist_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical mean rate of the series; of its chapter where it has none."""
    df = fine(spark, sf_dir)
    past = df.where(F.col("year") < TARGET)
    own, chapter = past.groupBy("series_key").agg(F.avg("rate").alias("own")), past.groupBy("l1").agg(F.avg("rate").alias("chapter"))
    return df.where(F.col("year") == TARGET).join(own, "series_key", "left").join(chapter, "l1", "left").select("series_key", F.round(F.coalesce("own", "chapter"), 6).alias("hist_mean"))


@query(with_(FINE, HIST) + f"SELECT series_key, round(1.02 * {_LAST}, 5) AS rolling, round({_LAST}, 5) AS direct FROM hist")
def forecast_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped rolling variant: the direct forecast times 1.02."""
    p = S.last(F.col("h"))
    return history(spark, sf_dir).select("series_key", F.round(1.02 * p, 5).alias("rolling"), F.round(p, 5).alias("direct"))


def windowed(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Methods that a window can give for every year at once: naive, mean3 and expanding mean of strictly earlier years."""
    w = W.partitionBy(key).orderBy(year)
    return df.select(key, year, value, F.lag(value).over(w).alias("naive"), F.avg(value).over(w.rowsBetween(-3, -1)).alias("mean3"), F.avg(value).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("prior_mean"))
