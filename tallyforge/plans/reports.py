"""Aggregates, rollups, fact tables and report payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import series as S
from ..operators.windows import quantiles, with_group
from ..sources.panels import TARGET, annual, fine, quarters, rate, table
from ..sources.snapshots import changes
from .anomalies import SCORE_SQL as SCORES
from .anomalies import risk_class, signals
from .base_sql import ANNUAL, FINE, QUARTERS, with_
from .features import WIDE_SQL, Z_LABEL_SQL, mid_year, wide, z_label
from .forecasts import CREDITS_SQL, GROWTH_SQL, HIST, IDENTITY_SQL, METHOD_SQL, RECENT_SQL, exec_rate, history, identity, target
from .registry import query
from .selection import BEST_SQL, FOUR, PARTS_SQL, RATE_BEST_SQL, VALID, best_method, labelled, long_form, med3, parts, rate_tournament, scored, smart_sql, walk, walk_sql, walked

r4 = lambda c: F.round(c, 4)
RISK_SQL = "CASE WHEN {r} < 0.60 THEN 'critical' WHEN {r} < 0.80 THEN 'attention' ELSE 'ok' END"


@query(with_(ANNUAL) + "SELECT l1, l2, CAST(grouping(l1) * 2 + grouping(l2) AS BIGINT) AS level, round(sum(opened), 4) AS opened, round(sum(committed), 4) AS committed, count(*) AS n FROM annual GROUP BY ROLLUP (l1, l2)")
def rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals at every level of the hierarchy, from one rollup."""
    return annual(spark, sf_dir).rollup("l1", "l2").agg(F.grouping_id().alias("level"), r4(F.sum("opened")).alias("opened"), r4(F.sum("committed")).alias("committed"), F.count("*").alias("n")).select("l1", "l2", "level", "opened", "committed", "n")


@query(with_(ANNUAL) + f"SELECT CASE WHEN grouping(l1) = 1 THEN 'TOTAL' ELSE l1 END AS l1, l2, round(sum(opened), 4) AS opened, count(DISTINCT series_key) AS series FROM annual WHERE year = {TARGET} GROUP BY GROUPING SETS ((l1, l2), ())")
def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals by chapter and programme with a grand total row."""
    df = annual(spark, sf_dir).where(F.col("year") == TARGET).groupingSets([["l1", "l2"], []], "l1", "l2").agg(F.grouping("l1").alias("g"), r4(F.sum("opened")).alias("opened"), F.count("series_key").alias("series"))
    return df.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("l1")).alias("l1"), "l2", "opened", "series")


@query(with_(ANNUAL) + f"SELECT p.l1, p.l2, round(p.kept * 0.9, 4) AS stale, round(s.x, 4) AS rebuilt FROM (SELECT l1, l2, sum(opened) AS kept FROM annual WHERE year = {TARGET} GROUP BY 1, 2) p JOIN (SELECT l1, l2, sum(opened) * 1.1 AS x FROM annual WHERE year = {TARGET} GROUP BY 1, 2) s USING (l1, l2)")
def rollup_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent rows replaced by the sum of their updated children."""
    a = annual(spark, sf_dir).where(F.col("year") == TARGET)
    parents = a.groupBy("l1", "l2").agg(r4(F.sum("opened") * 0.9).alias("stale"))
    rebuilt = a.withColumn("opened", F.col("opened") * 1.1).groupBy("l1", "l2").agg(r4(F.sum("opened")).alias("rebuilt"))
    return parents.join(rebuilt, ["l1", "l2"])


@query(with_(FINE) + "SELECT l1, year, round(sum(rate * opened) / sum(CASE WHEN rate IS NOT NULL THEN opened END), 6) AS weighted, round(avg(rate), 6) AS plain FROM fine GROUP BY 1, 2")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate weighted by credits, and the plain mean."""
    w = F.when(F.col("rate").isNotNull(), F.col("opened"))
    return fine(spark, sf_dir).groupBy("l1", "year").agg(F.round(F.sum(F.col("rate") * w) / F.sum(w), 6).alias("weighted"), F.round(F.avg("rate"), 6).alias("plain"))


@query(with_(FINE) + "SELECT l1, count(*) AS n, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate), 6) AS std_rate, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate, round(median(rate), 6) AS median_rate, round(quantile_cont(rate, 0.75), 6) AS p75, round(quantile_cont(rate, 0.9), 6) AS p90, count(DISTINCT l2) AS members FROM fine GROUP BY 1")
def multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many statistics of a chapter at once."""
    df = fine(spark, sf_dir)
    q = quantiles(df, "rate", {"median_rate": 0.5, "p75": 0.75, "p90": 0.9}, ("l1",)).select("l1", *[F.round(c, 6).alias(c) for c in ("median_rate", "p75", "p90")])
    six = lambda c: F.round(c, 6)
    stats = df.groupBy("l1").agg(F.count("*").alias("n"), six(F.avg("rate")).alias("mean_rate"), six(F.stddev_samp("rate")).alias("std_rate"), six(F.min("rate")).alias("min_rate"), six(F.max("rate")).alias("max_rate"), F.countDistinct("l2").alias("members"))
    return stats.join(q, "l1", "left")


@query(with_(FINE) + "SELECT year, round(median(rate), 6) AS median_rate, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate), 6) AS std_rate FROM fine GROUP BY 1")
def rate_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of rates by year."""
    df = fine(spark, sf_dir)
    q = quantiles(df, "rate", {"q": 0.5}, ("year",)).select("year", F.round("q", 6).alias("median_rate"))
    return df.groupBy("year").agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.stddev_samp("rate"), 6).alias("std_rate")).join(q, "year", "left")


@query(with_(ANNUAL) + f"""SELECT 'lines' AS label, CAST(count(DISTINCT series_key) AS DOUBLE) AS value FROM annual UNION ALL SELECT 'opened', round(sum(opened), 4) FROM annual WHERE year = {TARGET}
UNION ALL SELECT 'committed', round(sum(committed), 4) FROM annual WHERE year = {TARGET} UNION ALL SELECT 'rate', round(sum(committed) / sum(opened), 6) FROM annual WHERE year = {TARGET}""")
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures as label and value: one aggregation, unpivoted."""
    now = F.col("year") == TARGET
    total = lambda c: F.sum(F.when(now, F.col(c)))
    one = annual(spark, sf_dir).agg(F.countDistinct("series_key").cast("double").alias("lines"), r4(total("opened")).alias("opened"), r4(total("committed")).alias("committed"), F.round(total("committed") / total("opened"), 6).alias("rate"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in ("lines", "opened", "committed", "rate")])).alias("r")).select("r.*")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of a category."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return n.select("segment", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts of several columns. Small sets collected map-side, so rows are not expanded once for each distinct column."""
    size = lambda c: F.size(F.collect_set(c)).cast("long")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(size("o_orderstatus").alias("statuses"), size("o_orderpriority").alias("priorities"), size(F.year("o_orderdate")).alias("years"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2")
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not unique."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 2")


@query(with_(FINE) + f"SELECT l1, sum(opened)::DECIMAL(38, 4)::DOUBLE AS opened, dense_rank() OVER (ORDER BY round(sum(opened), 4) DESC) AS place FROM fine WHERE year = {TARGET} GROUP BY 1".replace("sum(opened)::DECIMAL(38, 4)::DOUBLE", "round(sum(opened), 2)"))
def dense_rank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by credits with their dense rank (the rank is over chapters, few rows)."""
    g = fine(spark, sf_dir).where(F.col("year") == TARGET).groupBy("l1").agg(r4(F.sum("opened")).alias("opened"))
    return g.withColumn("place", F.dense_rank().over(W.orderBy(F.desc("opened"))).cast("long"))


@query(with_(FINE) + f"SELECT l2, round(sum(opened), 4) AS opened, round(sum(committed), 4) AS committed, count(*) AS n, round(sum(committed) / sum(opened), 6) AS rate FROM fine WHERE year = {TARGET} GROUP BY 1 ORDER BY round(sum(committed), 4) DESC, l2 LIMIT 15")
def top_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen largest consumers with the ratio of their sums."""
    g = fine(spark, sf_dir).where(F.col("year") == TARGET).groupBy("l2").agg(r4(F.sum("opened")).alias("opened"), r4(F.sum("committed")).alias("committed"), F.count("*").alias("n"), F.round(F.sum("committed") / F.sum("opened"), 6).alias("rate"))
    return g.orderBy(F.desc("committed"), "l2").limit(15)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey LIMIT 25")
def top_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows farthest from a value: sort by absolute value with a unique second key."""
    return table(spark, sf_dir, "orders").orderBy(F.desc(F.abs(F.col("o_totalprice") - 150000)), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest orders of each priority, nulls last; the limit is applied before the shuffle."""
    w = W.partitionBy("o_orderpriority").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_orderpriority", "o_orderkey", "place")


_SNAP = f"old AS (SELECT series_key, rate AS p FROM fine WHERE year = {TARGET - 1}), new AS (SELECT series_key, rate AS p FROM fine WHERE year = {TARGET})"


@query(with_(FINE, _SNAP) + "SELECT series_key, round(new.p - old.p, 6) AS change, CASE WHEN new.p > old.p THEN 'up' ELSE 'down' END AS direction FROM new JOIN old USING (series_key) WHERE abs(new.p - old.p) >= 0.05")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed by five points or more between two runs."""
    at = lambda y: fine(spark, sf_dir).where(F.col("year") == y).select("series_key", "rate")
    return changes(at(TARGET), at(TARGET - 1), "series_key", "rate", 0.05).withColumn("change", F.round("change", 6))


FACT_SQL = f"""fact AS (SELECT 'history' AS kind, series_key, year, committed AS actual, CAST(NULL AS DOUBLE) AS predicted FROM fine WHERE year < {TARGET}
  UNION ALL SELECT 'validation', series_key, year, actual, predicted FROM preds WHERE method = 'Mean3' AND year = {TARGET}
  UNION ALL SELECT 'forecast', series_key, {TARGET + 1}, NULL, list_avg(list_append(h, actual)[greatest(len(h) - 1, 1):len(h) + 1]) FROM walk WHERE year = {TARGET})"""


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, series_key, year, actual, predicted: history, validation and forecast under each other."""
    hist = fine(spark, sf_dir, until=TARGET).select(F.lit("history").alias("kind"), "series_key", "year", F.col("committed").alias("actual"))
    w = walk(spark, sf_dir, (TARGET,))
    val = w.select(F.lit("validation").alias("kind"), "series_key", "year", "actual", S.mean3(F.col("h")).alias("predicted"))
    nxt = w.select(F.lit("forecast").alias("kind"), "series_key", F.lit(TARGET + 1).alias("year"), S.mean3(F.concat("h", F.array("actual"))).alias("predicted"))
    return hist.unionByName(val, allowMissingColumns=True).unionByName(nxt, allowMissingColumns=True)


@query(with_(FINE, walk_sql(), FACT_SQL) + "SELECT kind, series_key, year, round(actual, 4) AS actual, round(predicted, 5) AS predicted FROM fact")
def fact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact table of three kinds of rows."""
    return fact(spark, sf_dir).select("kind", "series_key", "year", F.round("actual", 4).alias("actual"), F.round("predicted", 5).alias("predicted"))


@query(with_(FINE, walk_sql(), FACT_SQL) + f"SELECT f.series_key, f.year, round(f.predicted, 5) AS predicted, l1, l2 FROM fact f JOIN (SELECT DISTINCT series_key, l1, l2 FROM fine) USING (series_key) WHERE kind = 'forecast'")
def recap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows with the attributes of their series."""
    dim = fine(spark, sf_dir).select("series_key", "l1", "l2").distinct()
    return fact(spark, sf_dir).where("kind = 'forecast'").join(dim, "series_key").select("series_key", "year", F.round("predicted", 5).alias("predicted"), "l1", "l2")


@query(with_(FINE, walk_sql(), FACT_SQL) + "SELECT section, label, value FROM (SELECT 'kinds' AS section, kind AS label, CAST(count(*) AS DOUBLE) AS value FROM fact GROUP BY 2 UNION ALL SELECT 'years', CAST(year AS VARCHAR), round(sum(coalesce(actual, predicted)), 4) FROM fact GROUP BY 2)")
def stacked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a sheet under each other, with their section."""
    f = fact(spark, sf_dir)
    a = f.groupBy(F.col("kind").alias("label")).agg(F.count("*").cast("double").alias("value")).select(F.lit("kinds").alias("section"), "label", "value")
    b = f.groupBy(F.col("year").cast("string").alias("label")).agg(r4(F.sum(F.coalesce("actual", "predicted"))).alias("value")).select(F.lit("years").alias("section"), "label", "value")
    return a.unionByName(b)


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","suppliers":[' || (SELECT coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') FROM supplier WHERE s_nationkey = n_nationkey) || ']}' AS payload FROM nation""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested payload of each nation as JSON."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("suppliers"))
    df = table(spark, sf_dir, "nation").join(s, "n_nationkey", "left")
    return df.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.coalesce("suppliers", F.array().cast("array<bigint>")).alias("suppliers"))).alias("payload"))


@query(with_(ANNUAL) + "SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM annual UNION ALL SELECT 'growth_vs_1995', round(sum(opened) FILTER (year = 2000) / sum(opened) FILTER (year = 1995) - 1, 6) FROM annual UNION ALL SELECT 'median_rate', round(median(committed / nullif(opened, 0)), 6) FROM annual UNION ALL SELECT 'weighted_rate', round(sum(committed) / sum(opened), 6) FROM annual UNION ALL SELECT 'at_risk', CAST(count(*) FILTER (committed / nullif(opened, 0) < 0.8) AS DOUBLE) FROM annual UNION ALL SELECT 'programmes', CAST(count(DISTINCT l2) AS DOUBLE) FROM annual")
def bi_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the dashboards, from one aggregation."""
    r = rate()
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("opened")))
    m = {"rows": F.count("*").cast("double"), "growth_vs_1995": F.round(at(2000) / at(1995) - 1, 6), "median_rate": F.lit(None).cast("double"), "weighted_rate": F.round(F.sum("committed") / F.sum("opened"), 6), "at_risk": F.count_if(r < 0.8).cast("double"), "programmes": F.countDistinct("l2").cast("double")}
    df = annual(spark, sf_dir)
    middle = quantiles(df.select(r.alias("r")), "r", {"q": 0.5})
    one = df.agg(*[v.alias(k) for k, v in m.items()]).crossJoin(F.broadcast(middle)).withColumn("median_rate", F.round("q", 6))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in m])).alias("r")).select("r.*")


@query(with_(ANNUAL) + "SELECT year, l1, round(sum(opened), 4) AS opened, round(sum(committed), 4) AS committed, round(avg(committed / nullif(opened, 0)), 6) AS avg_rate, count(*) FILTER (committed > 1.1 * ceiling) AS flagged FROM annual GROUP BY 1, 2")
def page_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart-ready sums, rates and flag counts by year and chapter."""
    return annual(spark, sf_dir).groupBy("year", "l1").agg(r4(F.sum("opened")).alias("opened"), r4(F.sum("committed")).alias("committed"), F.round(F.avg(rate()), 6).alias("avg_rate"), F.count_if(F.col("committed") > 1.1 * F.col("ceiling")).alias("flagged"))


@query(with_(FINE, GROWTH_SQL) + f"SELECT series_key, round((hi - lo) / nullif(p, 0) * 100, 4) AS band_width_pct FROM (SELECT series_key, committed * g AS p, greatest(committed * g * 0.9, 0) AS lo, committed * g * 1.1 AS hi FROM fine, growth WHERE year = {TARGET - 1})")
def band_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of a band in percent of its forecast; none where that is 0."""
    from .forecasts import growth

    df = fine(spark, sf_dir).where(F.col("year") == TARGET - 1).crossJoin(F.broadcast(growth(spark, sf_dir))).withColumn("p", F.col("committed") * F.col("g"))
    return df.select("series_key", F.round(F.try_divide(F.col("p") * 1.1 - F.greatest(F.col("p") * 0.9, F.lit(0.0)), F.nullif(F.col("p"), F.lit(0.0))) * 100, 4).alias("band_width_pct"))


# --- composite reports ---------------------------------------------------------------------------------
@query(with_(QUARTERS, WIDE_SQL) + f""", b AS (SELECT series_key, avg(t2) AS m, greatest(coalesce(stddev_samp(t2), 0.01), 0.005) AS s, avg(t4 - t2) AS gain FROM wide WHERE year < {TARGET} GROUP BY 1)
SELECT series_key, year, t2, t4, CASE WHEN year = {TARGET} THEN round(t2 + gain, 9) END AS predicted, CASE WHEN year = {TARGET} THEN round(abs(t4 - t2 - gain), 9) END AS error, CASE WHEN year = {TARGET} THEN round((t2 - m) / s, 5) END AS z FROM wide JOIN b USING (series_key)""")
def history_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series and year with mid-year and year-end rate; prediction, error and z for the target year."""
    w = wide(spark, sf_dir)
    b = w.where(F.col("year") < TARGET).groupBy("series_key").agg(F.avg("t2").alias("m"), F.greatest(F.coalesce(F.stddev_samp("t2"), F.lit(0.01)), F.lit(0.005)).alias("s"), F.avg(F.col("t4") - F.col("t2")).alias("gain"))
    now = lambda c, d: F.when(F.col("year") == TARGET, F.round(c, d))
    p = F.col("t2") + F.col("gain")
    return w.join(b, "series_key").select("series_key", "year", "t2", "t4", now(p, 9).alias("predicted"), now(F.abs(F.col("t4") - F.col("t2") - F.col("gain")), 9).alias("error"), now((F.col("t2") - F.col("m")) / F.col("s"), 5).alias("z"))


@query(with_(FINE, HIST) + f"""SELECT round(avg(abs(a - actual)), 3) AS mae_base, round(avg(abs(b - actual)), 3) AS mae_new, round(sqrt(avg(pow(a - actual, 2))), 3) AS rmse_base, round(sqrt(avg(pow(b - actual, 2))), 3) AS rmse_new,
  round((1 - sqrt(avg(pow(b - actual, 2))) / sqrt(avg(pow(a - actual, 2)))) * 100, 4) AS gain_pct FROM (SELECT {METHOD_SQL['Naive']} AS a, {METHOD_SQL['Weighted']} AS b, actual FROM hist JOIN target USING (series_key))""")
def model_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on one hold-out."""
    df = history(spark, sf_dir).join(target(spark, sf_dir), "series_key").select((S.naive(F.col("h")) - F.col("actual")).alias("a"), (S.weighted(F.col("h")) - F.col("actual")).alias("b"))
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return df.agg(F.round(F.avg(F.abs("a")), 3).alias("mae_base"), F.round(F.avg(F.abs("b")), 3).alias("mae_new"), F.round(rmse("a"), 3).alias("rmse_base"), F.round(rmse("b"), 3).alias("rmse_new"), F.round((1 - rmse("b") / rmse("a")) * 100, 4).alias("gain_pct"))


_RM = {"last": ("rs[len(rs)]", S.last), "mean": ("list_avg(rs)", S.mean), "median": ("list_median(rs)", S.median)}
RATE_WALK_SQL = f"""rw AS (SELECT v.series_key, v.year, v.committed AS actual, v.opened AS credits, list(p.rate ORDER BY p.year) FILTER (p.rate IS NOT NULL) AS rs
  FROM fine v JOIN fine p ON p.series_key = v.series_key AND p.year < v.year WHERE v.year IN {VALID} GROUP BY ALL HAVING count(p.rate) >= 2)"""


@query(with_(FINE, RATE_WALK_SQL) + "SELECT series_key, year, method, round(predicted, 3) AS predicted, round(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 100 * abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2) END, 4) AS smape FROM (" + " UNION ALL ".join(f"SELECT series_key, year, '{k}' AS method, actual, {s} * credits AS predicted FROM rw" for k, (s, _) in _RM.items()) + ")")
def rate_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rates times known credits against actuals, for each validation year with two earlier rates."""
    z = S.collapse(fine(spark, sf_dir), ["series_key"], "year", "committed", "opened", "rate").select("series_key", F.arrays_zip("years", "committeds", "openeds", "rates").alias("z"))
    at = z.select("series_key", "z", F.explode("z").alias("p")).where(F.col("p.years").isin(*VALID))
    rs = F.filter(F.transform(F.filter("z", lambda x: x["years"] < F.col("p.years")), lambda x: x["rates"]), lambda r: r.isNotNull())
    df = at.select("series_key", F.col("p.years").alias("year"), F.col("p.committeds").alias("actual"), F.col("p.openeds").alias("credits"), rs.alias("rs")).where(F.size("rs") >= 2)
    long = scored(long_form(df, ["series_key", "year", "actual"], {k: f(F.col("rs")) * F.col("credits") for k, (_, f) in _RM.items()}))
    return long.select("series_key", "year", "method", F.round("predicted", 3).alias("predicted"), F.round("smape", 4).alias("smape"))


@query(with_(FINE) + "SELECT series_key, max_by(opened, year) AS opened, max(year) AS year FROM fine WHERE opened > 0 GROUP BY 1")
def scenario_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest credits of each series."""
    return fine(spark, sf_dir).where("opened > 0").groupBy("series_key").agg(F.max_by("opened", "year").alias("opened"), F.max("year").alias("year"))


@query(with_(FINE, walk_sql(), BEST_SQL, SCORES) + f""", sc AS (SELECT series_key, max(round((z + jump + residual) / 3, 9)) AS score, max_by(year, struct_pack(a := round((z + jump + residual) / 3, 9), b := -year)) AS worst FROM sig GROUP BY 1), lc AS (SELECT series_key, max_by(opened, year) AS credits FROM fine WHERE year <= {TARGET} GROUP BY 1)
SELECT series_key, method, round(err, 4) AS err, round(credits, 4) AS credits, round(score, 6) AS score, worst FROM best JOIN lc USING (series_key) JOIN sc USING (series_key)""")
def manager_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload of each series: best method, its error, last credits, largest anomaly score and its year."""
    best = best_method(walked(spark, sf_dir).where(F.col("year") < TARGET))
    s = F.round((F.col("z") + F.col("jump") + F.col("residual")) / 3, 9)
    sc = signals(spark, sf_dir).groupBy("series_key").agg(F.max(F.struct(s.alias("s"), (-F.col("year")).alias("y"))).alias("b")).select("series_key", F.col("b.s").alias("score"), (-F.col("b.y")).cast("int").alias("worst"))
    lc = fine(spark, sf_dir).where(F.col("year") <= TARGET).groupBy("series_key").agg(F.max_by("opened", "year").alias("credits"))
    return best.join(lc, "series_key").join(sc, "series_key").select("series_key", "method", F.round("err", 4).alias("err"), F.round("credits", 4).alias("credits"), F.round("score", 6).alias("score"), "worst")


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL) + f"SELECT round(sum(p), 4) AS next_total, round(sum(nv), 4) AS last_total, round((sum(p) / sum(nv) - 1) * 100, 4) AS change_pct, round(sum(p) / sum(credits), 6) AS global_rate FROM (SELECT {smart_sql()} AS p, nv, credits FROM parts)")
def forecast_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the forecast, the last year and the implied rate."""
    df = parts(spark, sf_dir).select(S.smart(F.col("h"), F.col("dn"), F.col("er")).alias("p"), "nv", "credits")
    return df.agg(r4(F.sum("p")).alias("next_total"), r4(F.sum("nv")).alias("last_total"), F.round((F.sum("p") / F.sum("nv") - 1) * 100, 4).alias("change_pct"), F.round(F.sum("p") / F.sum("credits"), 6).alias("global_rate"))


@query(with_(FINE, walk_sql(), BEST_SQL) + f"SELECT series_key, method, round(h[len(h)], 4) AS last, round(list_avg(h[greatest(len(h) - 4, 1):len(h)]), 5) AS mean5, round(predicted, 5) AS forecast, round((predicted / nullif(h[len(h)], 0) - 1) * 100, 4) AS change_pct FROM best JOIN preds p USING (series_key, method) JOIN walk w USING (series_key) WHERE p.year = {TARGET} AND w.year = {TARGET}")
def next_year_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value, five-year mean, best method, its forecast and the change."""
    best = best_method(walked(spark, sf_dir).where(F.col("year") < TARGET)).select("series_key", "method")
    w = walk(spark, sf_dir, (TARGET,))
    long = long_form(w, ["series_key", "h"], {m: S.METHODS[m](F.col("h")) for m in FOUR}).join(best, ["series_key", "method"])
    last = S.last(F.col("h"))
    return long.select("series_key", "method", F.round(last, 4).alias("last"), F.round(S.mean(S.tail(F.col("h"), 5)), 5).alias("mean5"), F.round("predicted", 5).alias("forecast"), F.round((F.col("predicted") / F.nullif(last, F.lit(0.0)) - 1) * 100, 4).alias("change_pct"))


_YEARS = tuple(range(TARGET - 5, TARGET))


@query(with_(FINE, HIST, "pv AS (SELECT series_key, " + ", ".join(f"round(max(rate) FILTER (year = {y}), 6) AS taux_{y}" for y in _YEARS) + " FROM fine GROUP BY 1)") + "SELECT series_key, " + ", ".join(f"taux_{y}" for y in _YEARS) + f", round(credits * least(greatest({RECENT_SQL}, 0), 1.2), 3) AS predicted FROM hist JOIN target USING (series_key) JOIN pv USING (series_key)")
def known_credits_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of five years side by side and the forecast from known credits."""
    h = history(spark, sf_dir).join(target(spark, sf_dir), "series_key")
    pv = fine(spark, sf_dir).where(F.col("year").isin(*_YEARS)).groupBy("series_key").pivot("year", list(_YEARS)).agg(F.round(F.max("rate"), 6))
    return h.join(pv, "series_key").select("series_key", *[F.col(str(y)).alias(f"taux_{y}") for y in _YEARS], F.round(F.col("credits") * S.clip(S.recent_rate(F.col("rs")), 0, 1.2), 3).alias("predicted"))


@query(with_(QUARTERS, WIDE_SQL) + f", b AS (SELECT series_key, avg(t2) AS m, stddev_samp(t2) AS s FROM wide WHERE year < {TARGET} GROUP BY 1) SELECT series_key, year, t2, t4, round(m - 1.5 * s, 6) AS lo, round(m + 1.5 * s, 6) AS hi, year = {TARGET} AS is_target FROM wide JOIN b USING (series_key) WHERE series_key = '7'")
def line_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of one series with the band of its earlier years. The filter on the series reaches the scan's join before anything is aggregated."""
    w = wide(spark, sf_dir).where("series_key = '7'")
    b = w.where(F.col("year") < TARGET).groupBy("series_key").agg(F.avg("t2").alias("m"), F.stddev_samp("t2").alias("s"))
    return w.join(b, "series_key").select("series_key", "year", "t2", "t4", F.round(F.col("m") - 1.5 * F.col("s"), 6).alias("lo"), F.round(F.col("m") + 1.5 * F.col("s"), 6).alias("hi"), (F.col("year") == TARGET).alias("is_target"))


@query(with_(ANNUAL, IDENTITY_SQL) + f"SELECT i.series_key, round(o + i.i - t, 5) AS available, round(o * r, 4) AS committed, round(a.committed, 4) AS actual, round(abs(o * r - a.committed), 4) AS abs_error, round(abs(o * r - a.committed) / nullif(abs(a.committed), 0) * 100, 4) AS error_pct FROM ident i JOIN annual a ON a.l3 = i.series_key AND a.year = {TARGET}")
def validation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the budget identity against the year that came."""
    now = annual(spark, sf_dir).where(F.col("year") == TARGET).select(F.col("l3").alias("series_key"), F.col("committed").alias("actual"))
    p = F.col("o") * F.col("r")
    e = F.abs(p - F.col("actual"))
    return identity(spark, sf_dir).join(now, "series_key").select("series_key", F.round(F.col("o") + F.col("i") - F.col("t"), 5).alias("available"), F.round(p, 4).alias("committed"), F.round("actual", 4).alias("actual"), F.round(e, 4).alias("abs_error"), F.round(e / F.nullif(F.abs("actual"), F.lit(0.0)) * 100, 4).alias("error_pct"))


@query(with_(FINE, HIST, RATE_BEST_SQL) + ", lb AS (SELECT series_key, CASE WHEN cv IS NULL OR cv * 100 > 40 THEN 'uncertain' WHEN cv * 100 > 20 THEN 'acceptable' ELSE 'reliable' END AS reliability FROM (SELECT series_key, list_stddev_samp(rs) / nullif(list_avg(rs), 0) AS cv FROM hist)) SELECT reliability, count(*) AS n, round(avg(mape), 4) AS mean_error FROM rb JOIN lb USING (series_key) WHERE rn = 1 GROUP BY 1")
def error_by_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error of the winning rate model by reliability class."""
    return rate_tournament(spark, sf_dir).join(labelled(spark, sf_dir).select("series_key", "reliability"), "series_key").groupBy("reliability").agg(F.count("*").alias("n"), F.round(F.avg("mape"), 4).alias("mean_error"))


@query(with_(FINE, walk_sql()) + """, w AS (SELECT year, method, avg(smape) AS e FROM preds GROUP BY 1, 2) SELECT year, round(max(e) FILTER (method = 'Mean3'), 4) AS mean3, round(max(e) FILTER (method = 'Median'), 4) AS median_, round(max(e) FILTER (method = 'Naive'), 4) AS naive, round(max(e) FILTER (method = 'Trend'), 4) AS trend, min_by(method, struct_pack(a := round(e, 6), b := method)) AS winner FROM w GROUP BY 1""")
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error of every method in each year, side by side, and the year's winner."""
    e = walked(spark, sf_dir).groupBy("year", "method").agg(F.avg("smape").alias("e"))
    at = lambda m: F.round(F.max(F.when(F.col("method") == m, F.col("e"))), 4)
    return e.groupBy("year").agg(at("Mean3").alias("mean3"), at("Median").alias("median_"), at("Naive").alias("naive"), at("Trend").alias("trend"), F.min(F.struct(F.round("e", 6).alias("a"), F.col("method").alias("b"))).alias("w")).select("year", "mean3", "median_", "naive", "trend", F.col("w.b").alias("winner"))


_STRAT = {"naive": "nv", "drift": "dn", "exec_rate": "er", "median3": "list_median(list_filter([dn, nv, er], lambda x: x IS NOT NULL))", "robust": "rb"}


@query(with_(FINE, HIST, GROWTH_SQL, PARTS_SQL, "st AS (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, actual, {v} AS predicted FROM parts" for k, v in _STRAT.items()) + ")") + "SELECT strategy, count(*) AS n, round(median(e), 4) AS median_smape, round(avg(e), 4) AS mean_smape, round((sum(predicted) / sum(actual) - 1) * 100, 4) AS bias FROM (SELECT *, CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 100 * abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2) END AS e FROM st WHERE predicted IS NOT NULL) GROUP BY 1")
def experiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies scored on the target year."""
    long = scored(long_form(parts(spark, sf_dir), ["actual"], {"naive": F.col("nv"), "drift": F.col("dn"), "exec_rate": F.col("er"), "median3": med3(), "robust": F.col("rb")}))
    long = long.withColumnRenamed("method", "strategy")
    q = quantiles(long, "smape", {"q": 0.5}, ("strategy",)).select("strategy", F.round("q", 4).alias("median_smape"))
    return long.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("smape"), 4).alias("mean_smape"), F.round((F.sum("predicted") / F.sum("actual") - 1) * 100, 4).alias("bias")).join(q, "strategy")


_ZSQL = f"zz AS (SELECT q.series_key, q.taux, (q.taux - b.m) / b.s AS z FROM quarters q JOIN (SELECT series_key, avg(taux) AS m, greatest(coalesce(stddev_samp(taux), 0.01), 0.005) AS s FROM quarters WHERE quarter = 2 AND year < {TARGET} GROUP BY 1) b USING (series_key) WHERE q.quarter = 2 AND q.year = {TARGET})"


@query(with_(QUARTERS, WIDE_SQL, _ZSQL) + f""", st AS (SELECT series_key, round(avg(t4), 9) AS mean_t4, round(stddev_samp(t4), 6) AS std_t4, count(*) AS years FROM wide WHERE year < {TARGET} GROUP BY 1)
SELECT series_key, mean_t4, std_t4, years, round(z, 5) AS z, {Z_LABEL_SQL.format(v='taux', z='z')} AS label, t4 AS actual FROM st JOIN zz USING (series_key) JOIN (SELECT series_key, t4 FROM wide WHERE year = {TARGET}) USING (series_key)""")
def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts joined to history statistics and to what the target year brought."""
    w = wide(spark, sf_dir)
    st = w.where(F.col("year") < TARGET).groupBy("series_key").agg(F.round(F.avg("t4"), 9).alias("mean_t4"), F.round(F.stddev_samp("t4"), 6).alias("std_t4"), F.count("*").alias("years"))
    now = w.where(F.col("year") == TARGET).select("series_key", F.col("t4").alias("actual"))
    z = mid_year(spark, sf_dir).select("series_key", F.round("z", 5).alias("z"), z_label(F.col("taux"), F.col("z")).alias("label"))
    return st.join(z, "series_key").join(now, "series_key")


@query(with_(QUARTERS, WIDE_SQL) + f"SELECT category, count(DISTINCT series_key) AS lines, round(sum(annual) FILTER (year = {TARGET}), 4) AS total, round(avg(t4) FILTER (year = {TARGET - 1}), 9) AS before, round(avg(t4) FILTER (year = {TARGET}), 9) AS now FROM wide GROUP BY 1")
def budget_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, total and year-end rates by category."""
    at = lambda y, c: F.when(F.col("year") == y, F.col(c))
    return wide(spark, sf_dir).groupBy("category").agg(F.countDistinct("series_key").alias("lines"), r4(F.sum(at(TARGET, "annual"))).alias("total"), F.round(F.avg(at(TARGET - 1, "t4")), 9).alias("before"), F.round(F.avg(at(TARGET, "t4")), 9).alias("now"))


@query(with_(FINE) + f"""SELECT risk, CAST(CASE risk WHEN 'critical' THEN 1 WHEN 'attention' THEN 2 ELSE 3 END AS INT) AS place, n, opened, CASE risk WHEN 'critical' THEN 'act now' WHEN 'attention' THEN 'watch' ELSE 'none' END AS action FROM (
  SELECT {RISK_SQL.format(r='rate')} AS risk, count(*) AS n, round(sum(opened), 4) AS opened FROM fine WHERE year = {TARGET} AND rate IS NOT NULL GROUP BY 1)""")
def risk_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk classes in their own order, with the action to take."""
    g = fine(spark, sf_dir).where((F.col("year") == TARGET) & F.col("rate").isNotNull()).groupBy(risk_class(F.col("rate")).alias("risk")).agg(F.count("*").alias("n"), r4(F.sum("opened")).alias("opened"))
    place = F.when(F.col("risk") == "critical", 1).when(F.col("risk") == "attention", 2).otherwise(3)
    return g.select("risk", place.alias("place"), "n", "opened", F.when(F.col("risk") == "critical", "act now").when(F.col("risk") == "attention", "watch").otherwise("none").alias("action"))


@query(with_(FINE) + f"SELECT series_key, l1, round(rate, 6) AS rate FROM fine WHERE year = {TARGET} AND l1 = 'PROMO' AND rate < 0.8 AND contains(lower(series_key), '1')")
def interactive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the screens: chapter, risk and a part of the key."""
    return filtered(fine(spark, sf_dir, TARGET, TARGET + 1), chapter="PROMO", below=0.8, text="1").select("series_key", "l1", F.round("rate", 6).alias("rate"))


def filtered(df: DataFrame, chapter: str | None = None, below: float | None = None, text: str | None = None) -> DataFrame:
    """df under whichever filters are given."""
    checks: list[Column] = []
    if chapter is not None:
        checks.append(F.col("l1") == chapter)
    if below is not None:
        checks.append(F.col("rate") < below)
    if text:
        checks.append(F.contains(F.lower("series_key"), F.lit(text.lower())))
    for c in checks:
        df = df.where(c)
    return df


@query(with_(QUARTERS) + "SELECT year, quarter, category, round(sum(amount) / sum(sum(amount)) OVER (PARTITION BY year, category), 6) AS share, abs(round(sum(taux * annual) / sum(annual), 6) - 0.9) < 0.02 AS calibrated FROM quarters GROUP BY 1, 2, 3")
def calibration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rate of each quarter and category against its target, within two points."""
    g = quarters(spark, sf_dir).groupBy("year", "quarter", "category").agg(F.sum("amount").alias("a"), F.round(F.sum(F.col("taux") * F.col("annual")) / F.sum("annual"), 6).alias("w"))
    return with_group(g, ["year", "category"], F.sum("a").alias("t")).select("year", "quarter", "category", F.round(F.col("a") / F.col("t"), 6).alias("share"), (F.abs(F.col("w") - 0.9) < 0.02).alias("calibrated"))


@query(with_(FINE, HIST) + f"SELECT series_key, round(coalesce({RECENT_SQL} * {CREDITS_SQL}, 0), 3) AS exec_rate FROM hist LEFT JOIN target USING (series_key) WHERE l1 = 'LARGE'")
def chapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of one chapter."""
    h = history(spark, sf_dir).where("l1 = 'LARGE'").join(target(spark, sf_dir), "series_key", "left")
    return h.select("series_key", F.round(F.coalesce(exec_rate(h), F.lit(0.0)), 3).alias("exec_rate"))
