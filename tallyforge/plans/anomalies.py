"""Data-quality and business rules, scores and their agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import first_digit, first_digit_sql, normal_label, normal_label_sql
from ..operators import windows as O
from ..operators.series import smape
from ..sources.panels import TARGET, fine, movements, rate, table
from ..sources.shared import written_once
from .base_sql import FINE, MOVES, with_
from .registry import query
from .selection import BEST_SQL, VALID, best_method, walk_sql, walked

#: Row rules: name, severity, condition as SQL that both engines read, and the value reported.
ROW_RULES = {
    "over_execution": ("medium", "ceiling > 0 AND committed > 1.10 * ceiling", "committed / nullif(ceiling, 0)"),
    "negative_value": ("high", "committed < 0 OR opened < 0", "committed"),
    "major_transfer": ("medium", "opened > 0 AND abs(transfer_in - transfer_out) / nullif(opened, 0) > 0.5", "(transfer_in - transfer_out) / nullif(opened, 0)"),
    "transfer_inflation": ("medium", "opened > 0 AND transfer_in > opened", "transfer_in / nullif(opened, 0)"),
    "transfer_churn": ("low", "opened > 0 AND transfer_in / nullif(opened, 0) > 0.30 AND transfer_out / nullif(opened, 0) > 0.30", "(transfer_in + transfer_out) / nullif(opened, 0)"),
    "unused_topup": ("medium", "opened > 0 AND transfer_in / nullif(opened, 0) > 0.30 AND committed / nullif(opened, 0) < 0.80", "committed / nullif(opened, 0)"),
}


def _row_rule(rule: str) -> None:
    severity, cond, value = ROW_RULES[rule]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return movements(spark, sf_dir).where(cond).select("series_key", "year", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.round(F.expr(value), 6).alias("value"))

    run.__doc__ = f"Rows where {cond}."
    query(with_(MOVES) + f"SELECT series_key, year, '{rule}' AS rule, '{severity}' AS severity, round({value}, 6) AS value FROM moves WHERE {cond}", f"rule_{rule}")(run)


for _r in ROW_RULES:
    _row_rule(_r)


@query(with_(MOVES) + """, s AS (SELECT series_key, year, committed, lag(committed) OVER (PARTITION BY series_key ORDER BY year) AS p FROM moves)
SELECT series_key, year, 'huge_swing' AS rule, 'low' AS severity, round(committed / p, 6) AS value FROM s WHERE p > 0 AND committed > 0 AND (committed > 10 * p OR committed * 10 < p)""")
def rule_huge_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenfold change to the year before, either way."""
    return swings(spark, sf_dir)


def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("p"), F.col("committed")
    df = movements(spark, sf_dir).withColumn("p", F.lag("committed").over(O.ordered(["series_key"], "year")))
    return df.where((p > 0) & (c > 0) & ((c > 10 * p) | (c * 10 < p))).select("series_key", "year", F.lit("huge_swing").alias("rule"), F.lit("low").alias("severity"), F.round(c / p, 6).alias("value"))


_R = "committed / nullif(opened, 0)"


def _chronic(name: str, cond: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = movements(spark, sf_dir).where(f"opened > 0 AND {_R} {cond}").groupBy("series_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ", ").alias("years"))
        return df.where("n >= 2").select("series_key", F.lit(name).alias("rule"), "n", "years")

    run.__doc__ = f"Series with a rate {cond} in two years or more, and which."
    query(with_(MOVES) + f"SELECT series_key, '{name}' AS rule, count(*) AS n, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS years FROM moves WHERE opened > 0 AND {_R} {cond} GROUP BY 1 HAVING count(*) >= 2", f"rule_{name}")(run)


_chronic("chronic_under", "< 0.30")
_chronic("chronic_over", "> 1.0")


@query(with_(MOVES) + f"SELECT series_key, 'high_volatility' AS rule, count({_R}) AS n, round(stddev_samp({_R}) / avg({_R}), 6) AS cv FROM moves GROUP BY 1 HAVING count({_R}) >= 3 AND avg({_R}) > 0 AND stddev_samp({_R}) / avg({_R}) > 0.5")
def rule_high_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that vary by more than half their mean."""
    df = movements(spark, sf_dir).withColumn("r", rate()).groupBy("series_key").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return df.where("n >= 3 AND m > 0 AND s / m > 0.5").select("series_key", F.lit("high_volatility").alias("rule"), "n", F.round(F.col("s") / F.col("m"), 6).alias("cv"))


#: Words that mark a summary line (fixed values).
KEYWORDS = ("total", "sous-total", "sous total", "s/total")


def summary_lines(df: DataFrame, label: str, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """Rows whose label holds one of the keywords, in any case."""
    return df.where(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(label), k)))


#: Part names have none of the words above, so the query looks for one that they have besides.
PART_KEYWORDS = (*KEYWORDS, "ring")


@query("SELECT p_partkey, p_name FROM part WHERE " + " OR ".join(f"contains(lower(p_name), '{k}')" for k in PART_KEYWORDS))
def rule_summary_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that hold a summary word."""
    return summary_lines(table(spark, sf_dir, "part"), "p_name", PART_KEYWORDS).select("p_partkey", "p_name")


@query(f"SELECT p_brand || '-' || p_size AS key, count(DISTINCT {normal_label_sql('p_name')}) AS labels, array_to_string(list_sort(list(DISTINCT {normal_label_sql('p_name')}))[1:3], ' | ') AS examples FROM part GROUP BY 1 HAVING count(DISTINCT {normal_label_sql('p_name')}) > 1")
def rule_identity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one normalised label, and the first three."""
    df = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("key"), normal_label(F.col("p_name")).alias("label")).distinct()
    # the first three by a bounded window (a limit of its own before the shuffle), so no task holds all labels of a key
    first = df.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("label"))).where("i <= 3").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), " | ").alias("examples"))
    return df.groupBy("key").agg(F.count("*").alias("labels")).where("labels > 1").join(first, "key")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All row rules and huge swings from one scan of the panel: series_key, year, rule, severity, value. The value of the year before stands in the same row."""
    c, p = F.col("committed"), F.col("before")
    rows = movements(spark, sf_dir).withColumn("before", F.lag("committed").over(O.ordered(["series_key"], "year")))
    found = [F.struct(F.expr(f"coalesce({cond}, false)").alias("hit"), F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.round(F.expr(v), 6).alias("value")) for r, (s, cond, v) in ROW_RULES.items()]
    swing = F.coalesce((p > 0) & (c > 0) & ((c > 10 * p) | (c * 10 < p)), F.lit(False))
    found.append(F.struct(swing.alias("hit"), F.lit("huge_swing").alias("rule"), F.lit("low").alias("severity"), F.round(F.try_divide(c, p), 6).alias("value")))
    return rows.select("series_key", "year", F.explode(F.filter(F.array(*found), lambda x: x["hit"])).alias("r")).select("series_key", "year", "r.rule", "r.severity", "r.value")


FLAGS_SQL = "flags AS (" + " UNION ALL ".join(f"SELECT series_key, year, '{r}' AS rule, '{s}' AS severity, {v} AS value FROM moves WHERE {c}" for r, (s, c, v) in ROW_RULES.items()) + """
  UNION ALL SELECT series_key, year, 'huge_swing', 'low', committed / p FROM (SELECT *, lag(committed) OVER (PARTITION BY series_key ORDER BY year) AS p FROM moves) WHERE p > 0 AND committed > 0 AND (committed > 10 * p OR committed * 10 < p))"""


@query(with_(MOVES, FLAGS_SQL) + "SELECT rule, severity, count(*) AS n, count(DISTINCT series_key) AS series FROM flags GROUP BY 1, 2")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by rule and severity."""
    return flags(spark, sf_dir).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("series_key").alias("series"))


@query(with_(MOVES, FLAGS_SQL) + """, k AS (SELECT series_key, count(*) AS per_key FROM flags GROUP BY 1), ky AS (SELECT series_key, year, count(*) AS per_row FROM flags GROUP BY 1, 2)
SELECT m.series_key, m.year, coalesce(per_row, 0) AS row_flags, coalesce(per_key, 0) AS key_flags FROM moves m LEFT JOIN k USING (series_key) LEFT JOIN ky USING (series_key, year)""")
def rule_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each row, and of its series over all years."""
    per_row = flags(spark, sf_dir).groupBy("series_key", "year").agg(F.count("*").alias("n"))
    df = movements(spark, sf_dir).select("series_key", "year").join(per_row, ["series_key", "year"], "left").select("series_key", "year", F.coalesce("n", F.lit(0)).alias("row_flags"))
    return df.withColumn("key_flags", F.sum("row_flags").over(W.partitionBy("series_key")))


@query(with_(MOVES, FLAGS_SQL) + ", sus AS (SELECT DISTINCT series_key FROM flags WHERE rule = 'huge_swing') SELECT f.series_key, f.rule AS flag, m.year, m.opened, m.committed FROM (SELECT DISTINCT series_key, rule FROM flags WHERE series_key IN (SELECT series_key FROM sus)) f JOIN moves m USING (series_key)")
def flagged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years of the series that a swing flagged, once for each of its flags."""
    fl = flags(spark, sf_dir)
    sus = fl.where("rule = 'huge_swing'").select("series_key").distinct()
    f = fl.select("series_key", F.col("rule").alias("flag")).distinct().join(sus, "series_key", "left_semi")
    return f.join(movements(spark, sf_dir).select("series_key", "year", "opened", "committed"), "series_key")


@query(with_(MOVES, FLAGS_SQL) + """, lab AS (SELECT p_type AS l1, min(p_name) AS label FROM part GROUP BY 1)
SELECT f.rule, m.l1, label, count(*) AS n, round(sum(m.committed), 4) AS committed FROM flags f JOIN moves m USING (series_key, year) LEFT JOIN lab USING (l1) GROUP BY 1, 2, 3""")
def anomaly_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags joined back to their rows and to labels (deduplicated first), counted by rule and chapter."""
    labels = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("l1")).agg(F.min("p_name").alias("label"))
    df = flags(spark, sf_dir).select("series_key", "year", "rule").join(movements(spark, sf_dir), ["series_key", "year"]).join(labels, "l1", "left")
    return df.groupBy("rule", "l1", "label").agg(F.count("*").alias("n"), F.round(F.sum("committed"), 4).alias("committed"))


_BEN = "(" + ", ".join(f"({d}, {math.log10(1 + 1 / d)!r})" for d in range(1, 10)) + ")"


def benford_sql() -> list[str]:
    """Common tables that end with ben: l1, n, chi2."""
    return [f"dg AS (SELECT l1, {first_digit_sql('committed')} AS d FROM moves WHERE committed > 0)", "c AS (SELECT l1, d, count(*) AS n FROM dg GROUP BY 1, 2), t AS (SELECT l1, sum(n) AS n FROM c GROUP BY 1)",
        f"""ben AS (SELECT t.l1, CAST(t.n AS BIGINT) AS n, CASE WHEN t.n >= 10 THEN round(sum(pow(coalesce(c.n, 0) - t.n * e.p, 2) / (t.n * e.p)), 6) END AS chi2
  FROM t CROSS JOIN (VALUES {_BEN[1:-1]}) AS e(d, p) LEFT JOIN c ON c.l1 = t.l1 AND c.d = e.d GROUP BY t.l1, t.n)"""]


@query(with_(MOVES, *benford_sql()) + "SELECT l1, n, chi2 FROM ben")
def benford(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of first digits from Benford's law by chapter."""
    df = movements(spark, sf_dir).where("committed > 0").select("l1", first_digit(F.col("committed")).alias("d"))
    n = F.count("*")
    terms = [F.pow(F.sum((F.col("d") == d).cast("int")) - n * math.log10(1 + 1 / d), F.lit(2.0)) / (n * math.log10(1 + 1 / d)) for d in range(1, 10)]
    return df.groupBy("l1").agg(n.alias("n"), F.when(n >= 10, F.round(sum(terms[1:], terms[0]), 6)).alias("chi2"))


# --- scores -----------------------------------------------------------------------------------------
SCORE_SQL = f"""sig0 AS (SELECT series_key, year, abs((rate - avg(rate) OVER w) / nullif(stddev_samp(rate) OVER w, 0)) AS z, abs(rate - lag(rate) OVER (PARTITION BY series_key ORDER BY year)) AS jump FROM fine WINDOW w AS (PARTITION BY series_key)),
sig1 AS (SELECT s.series_key, s.year, coalesce(s.z, 0) AS z, coalesce(s.jump, 0) AS jump, coalesce(p.smape, 0) AS residual FROM sig0 s LEFT JOIN (SELECT series_key, year, smape FROM preds WHERE method = 'Naive') p USING (series_key, year)),
ends AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in ('z', 'jump', 'residual'))} FROM sig1),
sig AS (SELECT series_key, year, {', '.join(f'({c} - {c}_lo) / ({c}_hi - {c}_lo) AS {c}' for c in ('z', 'jump', 'residual'))} FROM sig1, ends)"""
SIGNALS = ("z", "jump", "residual")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals of each row scaled to 0..1: z (rate against its series), jump (rate against the year before), residual (error of the last value)."""
    w, o = W.partitionBy("series_key"), O.ordered(["series_key"], "year")
    known = F.col("year").isin(*VALID) & (F.row_number().over(o) > 2)  # a back-test year with two years or more before it
    last = F.lag("committed").over(o)
    df = fine(spark, sf_dir).select("series_key", "year", F.abs(F.try_divide(F.col("rate") - F.avg("rate").over(w), F.stddev_samp("rate").over(w))).alias("z"), F.abs(F.col("rate") - F.lag("rate").over(o)).alias("jump"), F.when(known, smape(F.col("committed"), last)).alias("residual"))
    return O.minmax(df.fillna(0.0, list(SIGNALS)), {s: s for s in SIGNALS}).select("series_key", "year", *SIGNALS)


@query(with_(FINE, walk_sql(), SCORE_SQL) + ", e AS (SELECT *, (z + jump + residual) / 3 AS score FROM sig), q AS (SELECT quantile_cont(score, 0.9) AS p FROM e) SELECT series_key, year, round(score, 6) AS score, score >= p AS top FROM e, q")
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three scaled signals; its top decile is marked."""
    df = signals(spark, sf_dir).withColumn("score", (F.col("z") + F.col("jump") + F.col("residual")) / 3)
    return df.crossJoin(F.broadcast(O.quantiles(df, "score", {"p": 0.9}))).select("series_key", "year", F.round("score", 6).alias("score"), (F.col("score") >= F.col("p")).alias("top"))


_TOP_SQL = f"cuts AS (SELECT {', '.join(f'quantile_cont({s}, 0.9) FILTER ({s} > 0) AS {s}_p' for s in SIGNALS)} FROM sig), votes AS (SELECT series_key, year, {', '.join(f'{s} > 0 AND {s} >= {s}_p AS {s}_top' for s in SIGNALS)} FROM sig, cuts)"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signals put a row into the top decile of their positive values."""
    df = signals(spark, sf_dir)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in SIGNALS])).alias("r")).select("r.*").where("v > 0")
    cuts = O.quantiles(long, "v", {"p": 0.9}, ("signal",)).agg(*[F.max(F.when(F.col("signal") == s, F.col("p"))).alias(f"{s}_p") for s in SIGNALS])
    return df.crossJoin(F.broadcast(cuts)).select("series_key", "year", *[((F.col(s) > 0) & (F.col(s) >= F.col(f"{s}_p"))).alias(f"{s}_top") for s in SIGNALS])


@query(with_(FINE, walk_sql(), SCORE_SQL, _TOP_SQL) + "SELECT series_key, year, " + " + ".join(f"CAST({s}_top AS INT)" for s in SIGNALS) + " AS n_signals FROM votes")
def signal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signals flag a row."""
    n = sum((F.col(f"{s}_top").cast("int") for s in SIGNALS[1:]), F.col("z_top").cast("int"))
    return votes(spark, sf_dir).select("series_key", "year", n.alias("n_signals"))


@query(with_(FINE, walk_sql(), SCORE_SQL, _TOP_SQL) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(count(*) FILTER ({a}_top AND {b}_top) * 1.0 / nullif(count(*) FILTER ({a}_top OR {b}_top), 0), 6) AS jaccard FROM votes" for a in SIGNALS for b in SIGNALS))
def signal_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each pair of signals: one aggregation for the whole matrix."""
    count = lambda c: F.sum(c.cast("int"))
    pairs = [(a, b) for a in SIGNALS for b in SIGNALS]
    t = lambda s: F.col(f"{s}_top")
    one = votes(spark, sf_dir).agg(*[F.round(F.try_divide(count(t(a) & t(b)), count(t(a) | t(b))), 6).alias(f"{a}_{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("jaccard")) for a, b in pairs])).alias("r")).select("r.*")


_SETS = f"big AS (SELECT DISTINCT series_key FROM fine WHERE opened > 600000), slow AS (SELECT DISTINCT series_key FROM fine WHERE rate < 0.3)"


@query(with_(FINE, _SETS) + """SELECT 'intersection' AS op, count(*) AS n FROM (SELECT * FROM big INTERSECT SELECT * FROM slow) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM big UNION SELECT * FROM slow)
UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM big EXCEPT SELECT * FROM slow)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union and difference of two sets of series."""
    df = fine(spark, sf_dir)
    a, b = df.where("opened > 600000").select("series_key").distinct(), df.where("rate < 0.3").select("series_key").distinct()
    size = lambda d, op: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return size(a.intersect(b), "intersection").unionByName(size(a.union(b).distinct(), "union")).unionByName(size(a.subtract(b), "difference"))


@query(with_(FINE, walk_sql(), SCORE_SQL) + ", top AS (SELECT series_key, year, (z + jump + residual) / 3 AS s, row_number() OVER (PARTITION BY series_key ORDER BY round((z + jump + residual) / 3, 9) DESC, year) AS rn FROM sig) SELECT series_key, year, round(s, 6) AS score FROM top WHERE rn = 1 ORDER BY round(s, 9) DESC, series_key LIMIT 30")
def suspects_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty series with the highest score, each with its worst year."""
    df = signals(spark, sf_dir).withColumn("s", (F.col("z") + F.col("jump") + F.col("residual")) / 3)
    worst = df.groupBy("series_key").agg(F.max(F.struct(F.round("s", 9).alias("r"), (-F.col("year")).alias("y"), "s")).alias("b")).select("series_key", (-F.col("b.y")).cast("int").alias("year"), "b.s")
    return worst.orderBy(F.desc(F.round("s", 9)), "series_key").limit(30).select("series_key", "year", F.round("s", 6).alias("score"))


_SUS = f"sus AS (SELECT series_key FROM fine WHERE year < {TARGET} GROUP BY 1 HAVING min(rate) < 0.25)"


@query(with_(FINE, walk_sql(), BEST_SQL, _SUS) + f"""SELECT scope, count(*) AS n, round(median(smape), 4) AS median_smape, round(avg(smape), 4) AS mean_smape, round(avg(CAST(smape <= 25 AS INT)) * 100, 4) AS within_25 FROM (
  SELECT smape, unnest(CASE WHEN series_key IN (SELECT series_key FROM sus) THEN ['all'] ELSE ['all', 'without suspects'] END) AS scope FROM best JOIN preds USING (series_key, method) WHERE year = {TARGET}) GROUP BY 1""")
def suspect_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-test error with and without suspect series: the suspects are marked by one semi-join, then both scopes are one aggregation."""
    preds = walked(spark, sf_dir)
    best = preds.where(F.col("year") == TARGET).join(best_method(preds.where(F.col("year") < TARGET)).select("series_key", "method"), ["series_key", "method"])
    sus = fine(spark, sf_dir, until=TARGET).groupBy("series_key").agg(F.min("rate").alias("m")).select("series_key", (F.col("m") < 0.25).alias("suspect"))
    df = best.join(sus, "series_key", "left").select("smape", F.explode(F.when(F.coalesce("suspect", F.lit(False)), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without suspects")))).alias("scope"))
    q = O.quantiles(df, "smape", {"q": 0.5}, ("scope",)).select("scope", F.round("q", 4).alias("median_smape"))
    return df.groupBy("scope").agg(F.count("*").alias("n"), F.round(F.avg("smape"), 4).alias("mean_smape"), F.round(F.avg((F.col("smape") <= 25).cast("int")) * 100, 4).alias("within_25")).join(q, "scope")


_FEAT = f"feat AS (SELECT series_key, (avg(rate) - (SELECT avg(rate) FROM fine WHERE year < {TARGET})) AS a, avg(rate) AS m, stddev_samp(rate) AS s FROM fine WHERE year < {TARGET} GROUP BY 1)"
K = 20


@query(with_(FINE, f"pts AS (SELECT series_key, round(avg(rate), 6) AS x, round(coalesce(stddev_samp(rate), 0), 6) AS y FROM fine WHERE year < {TARGET} GROUP BY 1)", f"nn AS (SELECT * FROM (SELECT p.series_key AS a, q.series_key AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, row_number() OVER (PARTITION BY p.series_key ORDER BY round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 9), q.series_key) AS rn FROM pts p JOIN pts q ON p.series_key <> q.series_key) WHERE rn <= {K})", "kd AS (SELECT a, max(d) AS kd FROM nn GROUP BY 1)", "lrd AS (SELECT nn.a, 1 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.a = nn.b GROUP BY 1)") + "SELECT nn.a AS series_key, round(avg(o.lrd) / any_value(l.lrd), 6) AS lof FROM nn JOIN lrd l ON l.a = nn.a JOIN lrd o ON o.a = nn.b GROUP BY 1")
def lof_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local outlier factor of each series in the plane of mean and deviation of its rate, by exact nearest neighbours."""
    from ..operators.outliers import local_outlier_factor

    pts = fine(spark, sf_dir, until=TARGET).groupBy("series_key").agg(F.round(F.avg("rate"), 6).alias("x"), F.round(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 6).alias("y"))
    return local_outlier_factor(pts, "series_key", ["x", "y"], K).select("series_key", F.round("lof", 6).alias("lof"))


#: The features that every multivariate signal reads: rates against ceiling and opened credits, net and gross transfer, top-up, changes of ceiling and commitments on the year before, distance from the chapter's mean rate.
EIGHT = ("rate_ceiling", "rate_opened", "transfer_net", "transfer_gross", "topup", "ceiling_change", "committed_change", "rate_vs_chapter")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_key, l1, year and EIGHT of each row of the movements panel, to six decimals; 0 where a ratio has no denominator or there is no year before.

    The chapter's mean of a year is aggregated and joined back, so no chapter is one task's window.
    """
    own = O.ordered(["series_key"], "year")
    over = lambda a, b: F.coalesce(F.try_divide(a, F.col(b)), F.lit(0.0))
    change = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lag(c).over(own), F.lag(c).over(own)), F.lit(0.0))
    net, gross = F.col("transfer_in") - F.col("transfer_out"), F.col("transfer_in") + F.col("transfer_out")
    df = movements(spark, sf_dir).select("series_key", "l1", "year", over(F.col("committed"), "ceiling").alias("rate_ceiling"), over(F.col("committed"), "opened").alias("rate_opened"), over(net, "opened").alias("transfer_net"), over(gross, "opened").alias("transfer_gross"), over(F.col("ceiling") - F.col("opened"), "opened").alias("topup"), change("ceiling").alias("ceiling_change"), change("committed").alias("committed_change"))
    df = O.with_group(df, ["l1", "year"], F.avg("rate_ceiling").alias("_mean")).withColumn("rate_vs_chapter", F.col("rate_ceiling") - F.col("_mean"))
    return df.select("series_key", "l1", "year", *[F.round(c, 6).alias(c) for c in EIGHT])


def standardised(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """df with each feature less its mean over its population deviation (0 where it is constant); one aggregation, one row broadcast."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    return df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in features}).drop(*one.columns)


def _ratio_sql(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


FEATURES_SQL = f"""feat0 AS (SELECT series_key, l1, year, {_ratio_sql('committed', 'ceiling')} AS rate_ceiling, {_ratio_sql('committed', 'opened')} AS rate_opened, {_ratio_sql('transfer_in - transfer_out', 'opened')} AS transfer_net,
  {_ratio_sql('transfer_in + transfer_out', 'opened')} AS transfer_gross, {_ratio_sql('ceiling - opened', 'opened')} AS topup, {_ratio_sql('ceiling - lag(ceiling) OVER w', 'lag(ceiling) OVER w')} AS ceiling_change,
  {_ratio_sql('committed - lag(committed) OVER w', 'lag(committed) OVER w')} AS committed_change FROM moves WINDOW w AS (PARTITION BY series_key ORDER BY year)),
feat1 AS (SELECT *, rate_ceiling - avg(rate_ceiling) OVER (PARTITION BY l1, year) AS rate_vs_chapter FROM feat0),
feats AS (SELECT series_key, l1, year, {', '.join(f'round({c}, 6) AS {c}' for c in EIGHT)} FROM feat1)"""


@query(with_(MOVES, FEATURES_SQL) + f"SELECT series_key, year, {', '.join(EIGHT)} FROM feats")
def feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight features of each series and year."""
    return feature_rows(spark, sf_dir).select("series_key", "year", *EIGHT)


_FAR = "sqrt(" + " + ".join(f"pow(p.{c} - q.{c}, 2)" for c in EIGHT) + ")"


@query(with_(MOVES, FEATURES_SQL, "pts AS (SELECT series_key || ':' || year AS id, series_key, year, " + ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in EIGHT) + " FROM feats)", f"""near AS (
  SELECT a, unnest(t) AS t FROM (SELECT p.id AS a, min({{'r': round({_FAR}, 9), 'b': q.id, 'd': {_FAR}}}, {K}) AS t FROM pts p JOIN pts q ON p.id <> q.id GROUP BY 1))""", "nn AS (SELECT a, t.b AS b, t.d AS d FROM near)", "kd AS (SELECT a, max(d) AS kd FROM nn GROUP BY 1)", "lrd AS (SELECT nn.a, 1 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.a = nn.b GROUP BY 1)", "lof AS (SELECT nn.a, avg(o.lrd) / any_value(l.lrd) AS lof FROM nn JOIN lrd l ON l.a = nn.a JOIN lrd o ON o.a = nn.b GROUP BY 1)") + "SELECT series_key, year, round(ln(lof), 5) AS log_lof FROM lof JOIN pts ON id = a")
def lof_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of the local outlier factor of each series and year in eight standardised features, by exact nearest neighbours."""
    from ..operators.outliers import local_outlier_factor

    rows = standardised(written_once(feature_rows(spark, sf_dir), "features"), EIGHT).withColumn("id", F.concat_ws(":", "series_key", "year"))
    found = local_outlier_factor(rows, "id", list(EIGHT), K)
    at = F.length("id") - 4
    return found.select(F.substring("id", F.lit(1), at - 1).alias("series_key"), F.substring("id", at + 1, F.lit(4)).cast("int").alias("year"), F.round(F.ln("lof"), 5).alias("log_lof"))


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation score of each row (200 trees on samples of 256), the top tenth flagged, and a combined risk class by the largest z of the series."""
    from ..operators.outliers import isolation_scores

    w = W.partitionBy("series_key")
    df = fine(spark, sf_dir, until=TARGET).withColumns({"z": F.coalesce(F.abs(F.try_divide(F.col("rate") - F.avg("rate").over(w), F.stddev_samp("rate").over(w))), F.lit(0.0)), "share": F.try_divide("opened", F.avg("opened").over(w))}).fillna(0.0)
    scored = isolation_scores(df, ["rate", "share", "z"], trees=200, sample=256, seed=42)
    cut = O.quantiles(scored, "isolation", {"p": 0.9})
    out = scored.withColumn("z_line", F.max("z").over(w)).crossJoin(F.broadcast(cut)).withColumn("outlier", F.col("isolation") >= F.col("p"))
    most = F.col("z_line")
    risk = F.when(F.col("outlier") & (most > 2), "critical").when(F.col("outlier") | (most > 2), "high").when(most > 1.5, "medium").otherwise("normal")
    priority = F.when(F.col("outlier") & (F.col("z") > 1.5), "P0").when(F.col("z") > 1.5, "P1").when(F.col("outlier"), "P2").otherwise("P4")
    return out.select("series_key", "year", F.round("isolation", 6).alias("isolation"), "outlier", risk.alias("risk"), priority.alias("priority"))


@query()
def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust Mahalanobis distance of each row in the eight standardised features, by the reweighted minimum covariance determinant of nine tenths of the rows."""
    from ..operators.covariance import robust_distance

    rows = written_once(standardised(feature_rows(spark, sf_dir), EIGHT), "features")
    return robust_distance(rows, list(EIGHT), share=0.9, seed=42).select("series_key", "year", F.round("distance", 6).alias("distance"))


_V = "CASE WHEN rate IS NULL THEN 0 ELSE rate END"


@query(with_(FINE) + f"""SELECT series_key, CASE WHEN rate < 0.60 THEN 'critical' WHEN rate < 0.80 THEN 'attention' ELSE 'ok' END AS risk, round(greatest(opened * (1 - rate), 0), 4) AS unspent,
  round(CASE WHEN rate < 0.80 THEN opened * greatest(0.80 - rate, 0) ELSE 0 END, 4) AS at_risk, round(greatest(rate - 0.10, 0), 6) AS lo, round(least(rate + 0.10, 1), 6) AS hi FROM fine WHERE year = {TARGET} AND rate IS NOT NULL""")
def var_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk class, unspent amount, amount at risk and a fixed band."""
    o, r = F.col("opened"), F.col("rate")
    zero = F.lit(0.0)
    return fine(spark, sf_dir, TARGET, TARGET + 1).where(r.isNotNull()).select("series_key", risk_class(r).alias("risk"), F.round(F.greatest(o * (1 - r), zero), 4).alias("unspent"), F.round(F.when(r < 0.80, o * F.greatest(0.80 - r, zero)).otherwise(zero), 4).alias("at_risk"), F.round(F.greatest(r - 0.10, zero), 6).alias("lo"), F.round(F.least(r + 0.10, F.lit(1.0)), 6).alias("hi"))


def risk_class(r: Column) -> Column:
    return F.when(r < 0.60, "critical").when(r < 0.80, "attention").otherwise("ok")


@query(with_(FINE) + f"SELECT CASE WHEN rate < 0.60 THEN 'critical' WHEN rate < 0.80 THEN 'attention' ELSE 'ok' END AS risk, count(*) AS n, round(sum(opened), 4) AS opened FROM fine WHERE year = {TARGET} AND rate IS NOT NULL GROUP BY 1")
def risk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and credits by risk class."""
    return fine(spark, sf_dir).where((F.col("year") == TARGET) & F.col("rate").isNotNull()).groupBy(risk_class(F.col("rate")).alias("risk")).agg(F.count("*").alias("n"), F.round(F.sum("opened"), 4).alias("opened"))


@query(with_(FINE, walk_sql()) + f"SELECT CASE WHEN e < 0.05 THEN 'under 5' WHEN e < 0.10 THEN '5 to 10' WHEN e < 0.15 THEN '10 to 15' ELSE 'over 15' END AS accuracy, method, count(*) AS n FROM (SELECT method, abs_error / nullif(abs(actual), 0) AS e FROM preds WHERE year = {TARGET} AND actual <> 0) GROUP BY 1, 2")
def accuracy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by size of the relative error."""
    e = F.col("abs_error") / F.abs("actual")
    label = F.when(e < 0.05, "under 5").when(e < 0.10, "5 to 10").when(e < 0.15, "10 to 15").otherwise("over 15")
    return walked(spark, sf_dir, (TARGET,)).where("actual <> 0").groupBy(label.alias("accuracy"), "method").agg(F.count("*").alias("n"))


@query(with_(FINE, walk_sql()) + f"SELECT series_key, round(min(smape), 4) AS residual FROM preds WHERE year = {TARGET} GROUP BY 1")
def residual_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the best method in the target year."""
    return walked(spark, sf_dir, (TARGET,)).groupBy("series_key").agg(F.round(F.min(smape(F.col("actual"), F.col("predicted"))), 4).alias("residual"))


# --- seven signals ----------------------------------------------------------------------------------
#: Share of rows below the cut of each signal; rules flag by their number instead.
SEVEN = {"rules": None, "isolation": 0.95, "forecast": 0.90, "lof": 0.95, "mahalanobis": 0.95, "benford": 0.90, "changepoint": 0.90}


@query(with_(MOVES, FLAGS_SQL) + """, ext AS (SELECT series_key, count(*) AS n FROM flags WHERE rule = 'huge_swing' GROUP BY 1), bus AS (SELECT series_key, year, count(*) AS n FROM flags WHERE rule <> 'huge_swing' GROUP BY 1, 2)
SELECT m.series_key, m.year, coalesce(e.n, 0) AS rules_key, coalesce(b.n, 0) AS rules_row, coalesce(e.n, 0) + coalesce(b.n, 0) AS rules FROM moves m LEFT JOIN ext e USING (series_key) LEFT JOIN bus b USING (series_key, year)""")
def signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each row: those of its year, and the extraction flags of its key, which count in every year."""
    df = rule_rows(spark, sf_dir)
    return df.select("series_key", "year", "rules_key", "rules_row", (F.col("rules_key") + F.col("rules_row")).alias("rules"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movements panel with rules_key (huge swings of the series in any year) and rules_row, from one collapse of each series."""
    c, before = F.col("committed"), F.lag("committed").over(O.ordered(["series_key"], "year"))
    hits = [F.expr(f"coalesce({cond}, false)").cast("long") for _, cond, _ in ROW_RULES.values()]
    swing = F.coalesce((before > 0) & (c > 0) & ((c > 10 * before) | (c * 10 < before)), F.lit(False)).cast("long")
    rows = movements(spark, sf_dir).select("*", before.alias("before"), swing.alias("swing"), sum(hits[1:], hits[0]).alias("rules_row"))
    return rows.withColumn("rules_key", F.sum("swing").over(W.partitionBy("series_key")))


def seven_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_key, year and the seven raw signals of each row of the movements panel.

    rules: flags of the row and extraction flags of its key; isolation, lof and mahalanobis: of the row in the eight standardised features; forecast: error of the last value, in the target
    year alone; benford: distance of its chapter's first digits, the chapters' median where there are too few; changepoint: the series' largest jump of rate or net transfer.
    """
    from ..operators.covariance import robust_distance
    from ..operators.outliers import isolation_scores, local_outlier_factor

    w, o = W.partitionBy("series_key"), O.ordered(["series_key"], "year")
    known = (F.col("year") == TARGET) & (F.row_number().over(o) > 2)
    rules = rule_rows(spark, sf_dir).select("series_key", "year", (F.col("rules_key") + F.col("rules_row")).cast("double").alias("rules"), F.coalesce(F.when(known, smape(F.col("committed"), F.col("before"))), F.lit(0.0)).alias("forecast"))
    feats = feature_rows(spark, sf_dir)
    jump = F.greatest(*[F.coalesce(F.abs(F.col(v) - F.lag(v).over(o)), F.lit(0.0)) for v in ("rate_ceiling", "transfer_net")])
    feats = written_once(feats.withColumn("jump", jump).withColumn("changepoint", F.max("jump").over(w)).drop("jump"), "features")  # its moments are a scan of their own
    rows = written_once(standardised(feats, EIGHT).join(rules, ["series_key", "year"]).withColumn("id", F.concat_ws(":", "series_key", "year")), "features")  # the fits below read it again and again
    scored = robust_distance(isolation_scores(rows, list(EIGHT), trees=300, sample=256, seed=42), list(EIGHT), share=0.9, seed=42).withColumnRenamed("distance", "mahalanobis")
    chapters = benford(spark, sf_dir).select("l1", "chi2")
    middle = O.quantiles(chapters, "chi2", {"m": 0.5})
    ben = chapters.crossJoin(F.broadcast(middle)).select("l1", F.coalesce("chi2", "m", F.lit(0.0)).alias("benford"))
    out = scored.join(local_outlier_factor(rows, "id", list(EIGHT), K), "id", "left").join(ben, "l1", "left")
    return written_once(out.select("series_key", "year", *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in SEVEN]), "signals")


def seven_flags(df: DataFrame) -> DataFrame:
    """The signals with one boolean each (name_flag): two rules or more, the share of rows above the cut else; of forecast errors, of the positive ones."""
    cut = {s: p for s, p in SEVEN.items() if p}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in cut])).alias("r")).select("r.*").where("signal <> 'forecast' OR v > 0")
    q = O.quantiles(long, "v", {"p90": 0.90, "p95": 0.95}, ("signal",))
    cuts = q.agg(*[F.max(F.when(F.col("signal") == s, F.col(f"p{round(p * 100)}"))).alias(f"{s}_p") for s, p in cut.items()])
    flags_ = [F.coalesce(F.col(s) >= F.col(f"{s}_p"), F.lit(False)).alias(f"{s}_flag") for s in cut]
    return df.crossJoin(F.broadcast(cuts)).select("*", (F.col("rules") >= 2).alias("rules_flag"), *flags_).drop(*cuts.columns)


@query()
def seven_signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the seven signals scaled to 0..1, its top decile, and how many signals flag the row."""
    df = seven_flags(seven_signals(spark, sf_dir))
    unit = O.minmax(df, {f"u_{s}": s for s in SEVEN})
    score = sum([F.col(f"u_{s}") for s in list(SEVEN)[1:]], F.col(f"u_{list(SEVEN)[0]}")) / len(SEVEN)
    n = sum([F.col(f"{s}_flag").cast("int") for s in list(SEVEN)[1:]], F.col("rules_flag").cast("int"))
    out = unit.select("series_key", "year", score.alias("score"), n.alias("n_signals"))
    return out.crossJoin(F.broadcast(O.quantiles(out, "score", {"p": 0.9}))).select("series_key", "year", F.round("score", 6).alias("score"), (F.col("score") >= F.col("p")).alias("top"), "n_signals")


def agreement(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, jaccard: rows that both flag over rows that either flags (0 if none), from one aggregation of name_flag columns."""
    count = lambda x: F.sum(x.cast("int"))
    f = lambda s: F.col(f"{s}_flag")
    pairs = [(a, b) for a in names for b in names]
    one = df.agg(*[F.coalesce(F.round(F.try_divide(count(f(a) & f(b)), count(f(a) | f(b))), 3), F.lit(0.0)).alias(f"{a}_{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("jaccard")) for a, b in pairs])).alias("r")).select("r.*")


@query()
def seven_signal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each pair of the seven signals."""
    return agreement(seven_flags(seven_signals(spark, sf_dir)), list(SEVEN))
