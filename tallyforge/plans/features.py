"""Window features, pivots and panel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import windows as O
from ..operators.series import clip
from ..sources.panels import TARGET, annual, fine, quarters
from .base_sql import ANNUAL, FINE, QUARTERS, with_
from .registry import query

r6 = lambda c: F.round(c, 6)


@query(with_(ANNUAL) + "SELECT year, series_key, l1, l2, opened, transfer_in, transfer_out, committed, ceiling FROM annual")
def panel_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual panel itself."""
    return annual(spark, sf_dir).select("year", "series_key", "l1", "l2", "opened", "transfer_in", "transfer_out", "committed", "ceiling")


@query(with_(FINE) + "SELECT year, series_key, opened, committed, round(rate, 6) AS rate FROM fine")
def panel_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finer panel with its guarded rate."""
    return fine(spark, sf_dir).select("year", "series_key", "opened", "committed", r6("rate").alias("rate"))


@query(with_(QUARTERS) + "SELECT category, series_key, year, quarter, amount, taux FROM quarters")
def panel_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarterly panel with cumulative rates."""
    return quarters(spark, sf_dir).select("category", "series_key", "year", "quarter", "amount", "taux")


@query(with_(QUARTERS) + "SELECT series_key, year, quarter, taux, lag(taux) OVER (PARTITION BY series_key, year ORDER BY quarter) AS taux_lag1 FROM quarters")
def lag_within_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the quarter before; the first quarter of a year has none."""
    return quarters(spark, sf_dir).select("series_key", "year", "quarter", "taux", F.lag("taux").over(O.ordered(["series_key", "year"], "quarter")).alias("taux_lag1"))


@query(with_(QUARTERS) + "SELECT series_key, year, quarter, taux, lag(taux) OVER (PARTITION BY series_key, quarter ORDER BY year) AS taux_lag4 FROM quarters")
def lag_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the same quarter in the year before (by row)."""
    return quarters(spark, sf_dir).select("series_key", "year", "quarter", "taux", F.lag("taux").over(O.ordered(["series_key", "quarter"], "year")).alias("taux_lag4"))


@query(with_(FINE) + """SELECT series_key, year, lag(committed) OVER w AS lag1, lag(committed, 2) OVER w AS lag2, round(lag(rate) OVER w, 6) AS rate_lag1, lag(opened) OVER w AS opened_lag1 FROM fine WINDOW w AS (PARTITION BY series_key ORDER BY year)""")
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of amount, rate and credits."""
    w = O.ordered(["series_key"], "year")
    return fine(spark, sf_dir).select("series_key", "year", F.lag("committed").over(w).alias("lag1"), F.lag("committed", 2).over(w).alias("lag2"), r6(F.lag("rate").over(w)).alias("rate_lag1"), F.lag("opened").over(w).alias("opened_lag1"))


@query(with_(QUARTERS) + "SELECT series_key, year, quarter, round(amount / avg(amount) OVER (PARTITION BY category, quarter), 6) AS lf_ratio FROM quarters")
def ratio_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount over the mean of its category and quarter. The mean is aggregated and joined back, so a large category is no single task's window."""
    return O.with_group(quarters(spark, sf_dir), ["category", "quarter"], F.avg("amount").alias("m")).select("series_key", "year", "quarter", r6(F.col("amount") / F.col("m")).alias("lf_ratio"))


@query(with_(FINE) + "SELECT series_key, year, round(opened / sum(opened) OVER (PARTITION BY l1, year), 8) AS lf_share FROM fine")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a series in its chapter and year."""
    return O.with_group(fine(spark, sf_dir), ["l1", "year"], F.sum("opened").alias("s")).select("series_key", "year", F.round(F.col("opened") / F.col("s"), 8).alias("lf_share"))


@query(with_(FINE) + "SELECT series_key, year, round(avg(rate) OVER (PARTITION BY series_key ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_mean FROM fine")
def expanding_prior_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rate of strictly earlier years."""
    return fine(spark, sf_dir).select("series_key", "year", r6(F.avg("rate").over(O.before(["series_key"], "year"))).alias("prior_mean"))


@query(with_(FINE) + """SELECT series_key, year, round(avg(committed) OVER (PARTITION BY series_key ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 5) AS mean3,
  count(*) OVER (PARTITION BY series_key ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM fine""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of up to three earlier years."""
    w = O.before(["series_key"], "year", 3)
    return fine(spark, sf_dir).select("series_key", "year", F.round(F.avg("committed").over(w), 5).alias("mean3"), F.count("*").over(w).alias("n"))


@query(with_(QUARTERS) + "SELECT series_key, year, quarter, max(amount) OVER (PARTITION BY series_key, year ORDER BY quarter) AS running FROM quarters")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest amount so far in the year: never falling."""
    return quarters(spark, sf_dir).select("series_key", "year", "quarter", F.max("amount").over(O.ordered(["series_key", "year"], "quarter").rowsBetween(W.unboundedPreceding, 0)).alias("running"))


@query(with_(FINE) + "SELECT series_key, year, round((committed - p) / nullif(p, 0), 6) AS yoy FROM (SELECT *, lag(committed) OVER (PARTITION BY series_key ORDER BY year) AS p FROM fine)")
def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change to the year before; none after a zero."""
    p = F.lag("committed").over(O.ordered(["series_key"], "year"))
    return fine(spark, sf_dir).withColumn("p", p).select("series_key", "year", r6(F.try_divide(F.col("committed") - F.col("p"), F.col("p"))).alias("yoy"))


@query(with_(FINE) + "SELECT series_key, year, round(CASE WHEN p > 0 AND committed > 0 THEN ln(committed / p) END, 6) AS log_return FROM (SELECT *, lag(committed) OVER (PARTITION BY series_key ORDER BY year) AS p FROM fine)")
def log_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of the ratio to the year before; none where either is zero."""
    p = F.lag("committed").over(O.ordered(["series_key"], "year"))
    return fine(spark, sf_dir).withColumn("p", p).select("series_key", "year", r6(F.when((F.col("p") > 0) & (F.col("committed") > 0), F.ln(F.col("committed") / F.col("p")))).alias("log_return"))


@query(with_(FINE) + """, d AS (SELECT series_key, year, greatest(abs(rate - lag(rate) OVER w), abs((committed - lag(committed) OVER w) / nullif(lag(committed) OVER w, 0))) AS jump FROM fine WINDOW w AS (PARTITION BY series_key ORDER BY year))
SELECT series_key, year, round(jump, 6) AS jump, round(max(jump) OVER (PARTITION BY series_key), 6) AS changepoint FROM d""")
def changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest relative or rate jump of a row and of its series."""
    w = O.ordered(["series_key"], "year")
    jump = F.greatest(F.abs(F.col("rate") - F.col("r1")), F.abs(F.try_divide(F.col("committed") - F.col("c1"), F.col("c1"))))
    df = fine(spark, sf_dir).withColumns({"r1": F.lag("rate").over(w), "c1": F.lag("committed").over(w)}).withColumn("jump", jump)
    return df.select("series_key", "year", r6("jump").alias("jump"), r6(F.max("jump").over(W.partitionBy("series_key"))).alias("changepoint"))


@query(with_(FINE) + """SELECT series_key, year, round(z, 6) AS z, abs(z) > 1.5 AS flagged FROM (
  SELECT series_key, year, (rate - avg(rate) OVER w) / nullif(stddev_samp(rate) OVER w, 0) AS z FROM fine WINDOW w AS (PARTITION BY series_key))""")
def zscore_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of each year from its series in sample deviations; flagged above one and a half."""
    w = W.partitionBy("series_key")
    z = F.try_divide(F.col("rate") - F.avg("rate").over(w), F.stddev_samp("rate").over(w))
    return fine(spark, sf_dir).withColumn("z", z).select("series_key", "year", r6("z").alias("z"), (F.abs("z") > 1.5).alias("flagged"))


Z_LABEL_SQL = "CASE WHEN {v} = 0 THEN 'zero rate' WHEN {z} < -3 THEN 'critical' WHEN {z} < -2 THEN 'strong' WHEN {z} < -1.5 THEN 'unusual' END"


@query(with_(QUARTERS) + f""", b AS (SELECT series_key, avg(taux) AS m, greatest(coalesce(stddev_samp(taux), 0.01), 0.005) AS s FROM quarters WHERE quarter = 2 AND year < {TARGET} GROUP BY 1),
z AS (SELECT series_key, taux, (taux - m) / s AS z FROM quarters JOIN b USING (series_key) WHERE quarter = 2 AND year = {TARGET})
SELECT series_key, taux, round(z, 5) AS z, {Z_LABEL_SQL.format(v='taux', z='z')} AS label FROM z""")
def zscore_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-year rate against earlier years, with a floor under the deviation, and its label."""
    return mid_year(spark, sf_dir).select("series_key", "taux", F.round("z", 5).alias("z"), z_label(F.col("taux"), F.col("z")).alias("label"))


def mid_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarters(spark, sf_dir).where("quarter = 2")
    base = q.where(F.col("year") < TARGET).groupBy("series_key").agg(F.avg("taux").alias("m"), F.greatest(F.coalesce(F.stddev_samp("taux"), F.lit(0.01)), F.lit(0.005)).alias("s"))
    return q.where(F.col("year") == TARGET).join(base, "series_key").withColumn("z", (F.col("taux") - F.col("m")) / F.col("s"))


def z_label(value: Column, z: Column) -> Column:
    return F.when(value == 0, "zero rate").when(z < -3, "critical").when(z < -2, "strong").when(z < -1.5, "unusual")


_P = ", ".join(f"max(taux) FILTER (quarter = {q}) AS t{q}" for q in (1, 2, 3, 4))
WIDE_SQL = f"wide AS (SELECT category, series_key, year, {_P}, max(annual) AS annual FROM quarters GROUP BY 1, 2, 3)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters side by side: t1..t4. The pivot names its values, so it needs no pass to find them."""
    df = quarters(spark, sf_dir).groupBy("category", "series_key", "year").pivot("quarter", [1, 2, 3, 4]).agg(F.max("taux").alias("t"), F.max("annual").alias("a"))
    return df.select("category", "series_key", "year", *[F.col(f"{q}_t").alias(f"t{q}") for q in (1, 2, 3, 4)], F.greatest(*[F.col(f"{q}_a") for q in (1, 2, 3, 4)]).alias("annual"))


@query(with_(QUARTERS, WIDE_SQL) + "SELECT series_key, year, t1, t2, t3, t4 FROM wide")
def pivot_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters side by side."""
    return wide(spark, sf_dir).select("series_key", "year", "t1", "t2", "t3", "t4")


@query(with_(QUARTERS, WIDE_SQL) + "SELECT c.series_key, c.year, c.t1, c.t2, c.t4 AS target, p.t2 AS t2_prev, p.t4 AS t4_prev, round(c.t2 - p.t2, 6) AS t2_gain FROM wide c JOIN wide p ON p.series_key = c.series_key AND p.year = c.year - 1 WHERE c.t1 + c.t2 + c.t3 + c.t4 + p.t1 + p.t2 + p.t3 + p.t4 IS NOT NULL")
def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a year joined to the year before, both with four quarters: a window over each series instead of a self-join."""
    w = O.ordered(["series_key"], "year")
    full = (F.col("t1") + F.col("t2") + F.col("t3") + F.col("t4")).isNotNull()
    df = wide(spark, sf_dir).where(full).withColumns({"y": F.lag("year").over(w), "t2_prev": F.lag("t2").over(w), "t4_prev": F.lag("t4").over(w)}).where(F.col("y") == F.col("year") - 1)
    return df.select("series_key", "year", "t1", "t2", F.col("t4").alias("target"), "t2_prev", "t4_prev", r6(F.col("t2") - F.col("t2_prev")).alias("t2_gain"))


@query(with_(QUARTERS, WIDE_SQL) + "SELECT c.series_key, c.year, c.t4, p.t4 AS t4_prev FROM wide c JOIN wide p ON p.series_key = c.series_key AND p.year + 1 = c.year")
def self_join_prev_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join form of the same: cur.year = prev.year + 1."""
    df = wide(spark, sf_dir).select("series_key", "year", "t4")
    prev = df.select("series_key", (F.col("year") + 1).alias("year"), F.col("t4").alias("t4_prev"))
    return df.join(prev, ["series_key", "year"])


@query(with_(QUARTERS, WIDE_SQL) + f""", med AS (SELECT median(t2) AS m2, median(t4) AS m4 FROM wide WHERE year < {TARGET})
SELECT c.series_key, c.t2, coalesce(c.t1, c.t2) AS t1, coalesce(p.t2, m2) AS t2_prev, coalesce(p.t4, m4) AS t4_prev, p.t2 IS NULL AS filled FROM wide c LEFT JOIN (SELECT * FROM wide WHERE CAST(series_key AS INT) % 3 <> 0) p ON p.series_key = c.series_key AND p.year = c.year - 1, med WHERE c.year = {TARGET} AND c.t2 IS NOT NULL""")
def snapshot_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training snapshot with gaps filled: lags of the previous year, else the median; T1, else T2. A third of the series is treated as new."""
    w = wide(spark, sf_dir)
    past = w.where(F.col("year") < TARGET)
    med = O.quantiles(past, "t2", {"m2": 0.5}).crossJoin(F.broadcast(O.quantiles(past, "t4", {"m4": 0.5})))
    prev = w.where((F.col("year") == TARGET - 1) & (F.col("series_key").cast("int") % 3 != 0)).select("series_key", F.col("t2").alias("p2"), F.col("t4").alias("p4"))
    df = w.where((F.col("year") == TARGET) & F.col("t2").isNotNull()).join(prev, "series_key", "left").crossJoin(F.broadcast(med))
    return df.select("series_key", "t2", F.coalesce("t1", "t2").alias("t1"), F.coalesce("p2", "m2").alias("t2_prev"), F.coalesce("p4", "m4").alias("t4_prev"), F.col("p2").isNull().alias("filled"))


@query(with_(FINE) + f"SELECT series_key, year, rank() OVER (ORDER BY round(rate, 4) DESC NULLS LAST) AS rank_min, dense_rank() OVER (ORDER BY round(rate, 4) DESC NULLS LAST) AS rank_dense FROM fine WHERE year = {TARGET}")
def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum and dense rank over all rows, from ranked distinct values: the sort has one row a value, not one a row."""
    df = fine(spark, sf_dir).where(F.col("year") == TARGET).withColumn("v", F.round("rate", 4))
    values = df.groupBy("v").agg(F.count("*").alias("c"))
    w = W.orderBy(F.desc_nulls_last("v"))
    ranked = values.select("v", (F.sum("c").over(w) - F.col("c") + 1).alias("rank_min"), F.row_number().over(w).cast("long").alias("rank_dense"))
    return df.join(ranked, df.v.eqNullSafe(ranked.v)).select("series_key", "year", "rank_min", "rank_dense")


@query(with_(FINE) + "SELECT series_key, year, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (opened - lo) / (hi - lo) END, 8) AS scaled FROM fine, (SELECT min(opened) AS lo, max(opened) AS hi FROM fine)")
def minmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column scaled to 0..1 by its extremes (one broadcast row)."""
    return O.minmax(fine(spark, sf_dir), {"scaled": "opened"}).select("series_key", "year", F.round("scaled", 8).alias("scaled"))


@query(with_(FINE) + "SELECT series_key, year, opened >= p AS top FROM fine, (SELECT quantile_cont(opened, 0.9) AS p FROM fine)")
def top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at or above the 90th percentile (interpolated)."""
    df = fine(spark, sf_dir)
    return df.crossJoin(F.broadcast(O.quantiles(df, "opened", {"p": 0.9}))).select("series_key", "year", (F.col("opened") >= F.col("p")).alias("top"))


@query("SELECT l_partkey AS part, count(DISTINCT year(l_shipdate)) AS years, count(DISTINCT year(l_shipdate)) < 3 AS low_history FROM lineitem GROUP BY 1")
def history_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years on record of each part; few are flagged. Distinct years are collected before the shuffle."""
    from ..sources.panels import table

    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct(F.year("l_shipdate")).alias("years")).withColumn("low_history", F.col("years") < 3)


@query(with_(QUARTERS) + f"SELECT series_key, round(stddev_pop(taux), 8) AS volatility, round(stddev_pop(taux) FILTER (year < {TARGET}), 8) AS volatility_no_leak FROM quarters WHERE quarter = 4 GROUP BY 1")
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of year-end rates, with and without the year to predict."""
    q = quarters(spark, sf_dir).where("quarter = 4")
    return q.groupBy("series_key").agg(F.round(F.stddev_pop("taux"), 8).alias("volatility"), F.round(F.stddev_pop(F.when(F.col("year") < TARGET, F.col("taux"))), 8).alias("volatility_no_leak"))


@query(with_(FINE) + """SELECT series_key, year, round(regr_slope(committed, year - 2000) OVER (PARTITION BY series_key ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS slope,
  round(avg(committed) OVER (PARTITION BY series_key ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_past, lag(committed) OVER (PARTITION BY series_key ORDER BY year) AS lag1 FROM fine QUALIFY count(*) OVER (PARTITION BY series_key ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2""")
def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of pooled models, all from strictly earlier years: slope, mean, last value."""
    return pooled(spark, sf_dir).select("series_key", "year", F.round("slope", 3).alias("slope"), F.round("mean_past", 6).alias("mean_past"), "lag1")


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, o = O.before(["series_key"], "year"), O.ordered(["series_key"], "year")
    y, x = F.col("committed"), (F.col("year") - 2000).cast("double")
    df = fine(spark, sf_dir).withColumns({"n": F.count("*").over(w), "slope": F.regr_slope(y, x).over(w), "mean_past": F.avg(y).over(w), "lag1": F.lag(y).over(o), "lag2": F.lag(y, 2).over(o)})
    return df.where("n >= 2")


@query(with_(FINE) + "SELECT series_key, year, round(CASE WHEN rate IS NULL THEN NULL ELSE least(greatest(rate, 0.4), 0.9) END, 6) AS banded, round(committed / (opened + 1e-9), 6) AS eps_rate FROM fine")
def clipped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates kept in a band (nulls stay) and rates with an epsilon under the bar."""
    return fine(spark, sf_dir).select("series_key", "year", r6(clip(F.col("rate"), 0.4, 0.9)).alias("banded"), r6(F.col("committed") / (F.col("opened") + F.lit(1e-9))).alias("eps_rate"))
