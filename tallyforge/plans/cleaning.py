"""Cleaning, hierarchy, joins and scalar functions. Raw sheets are rebuilt from the tables as cells in the reference layout: two physical rows a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as X
from ..operators import windows as O
from ..sources import cells as C
from ..sources.files import year_of_name
from ..sources.panels import TARGET, annual, fine, movements, quarters, table
from ..sources.shared import fresh_path
from ..sources.workbook import read_cells, write_workbook
from .base_sql import ANNUAL, FINE, MOVES, QUARTERS, with_
from .registry import query

# The sheet: regions, nations and suppliers of the annual panel, one record each, in order; a record names exactly one level.
_RECORDS = """recs AS (
  SELECT year, row_number() OVER (PARTITION BY year ORDER BY l1, coalesce(l2, ''), coalesce(CAST(l3 AS INT), -1)) - 1 AS i, CASE WHEN l2 IS NULL THEN l1 END AS b, CASE WHEN l2 IS NOT NULL AND l3 IS NULL THEN l2 END AS c, l3 AS d,
    'label ' || coalesce(l3, l2, l1) AS h, opened AS k, transfer_in AS m, transfer_out AS o, ceiling AS ab, committed AS ah FROM (
      SELECT year, l1, l2, l3, opened, transfer_in, transfer_out, ceiling, committed FROM annual
      UNION ALL SELECT year, l1, l2, NULL, round(sum(opened), 4), round(sum(transfer_in), 4), round(sum(transfer_out), 4), round(sum(ceiling), 4), round(sum(committed), 4) FROM annual GROUP BY 1, 2, 3
      UNION ALL SELECT year, l1, NULL, NULL, round(sum(opened), 4), round(sum(transfer_in), 4), round(sum(transfer_out), 4), round(sum(ceiling), 4), round(sum(committed), 4) FROM annual GROUP BY 1, 2))"""
#: Amount columns of the sheet by letter.
_AMOUNTS = {"k": "opened", "m": "transfer_in", "o": "transfer_out", "ab": "ceiling", "ah": "committed"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy as ordered records: year, i, codes b, c, d (one is given), h label, k opened, m and o transfers, ab ceiling, ah committed."""
    a = annual(spark, sf_dir).select("year", "l1", "l2", "l3", *_AMOUNTS.values())
    up = lambda keys: a.groupBy("year", *keys).agg(*[F.round(F.sum(c), 4).alias(c) for c in _AMOUNTS.values()])
    none = F.lit(None).cast("string")
    al = a.unionByName(up(["l1", "l2"]).withColumn("l3", none)).unionByName(up(["l1"]).withColumns({"l2": none, "l3": none}))
    i = F.row_number().over(W.partitionBy("year").orderBy("l1", F.coalesce("l2", F.lit("")), F.coalesce(F.col("l3").cast("int"), F.lit(-1)))) - 1
    return al.select("year", i.alias("i"), F.when(F.col("l2").isNull(), F.col("l1")).alias("b"), F.when(F.col("l2").isNotNull() & F.col("l3").isNull(), F.col("l2")).alias("c"), F.col("l3").alias("d"), F.concat(F.lit("label "), F.coalesce("l3", "l2", "l1")).alias("h"), *[F.col(c).alias(letter) for letter, c in _AMOUNTS.items()])


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells: file, row_nr, b, c, d, h, k, m, o, ab, ah; the top row has label and amounts, the row below it the code."""
    r = records(spark, sf_dir)
    file = F.format_string("ledger-%d", "year")
    top = r.select(file.alias("file"), (6 + 2 * F.col("i")).alias("row_nr"), *[F.lit(None).cast("string").alias(c) for c in "bcd"], "h", *[F.col(c).cast("string").alias(c) for c in _AMOUNTS])
    low = r.select(file.alias("file"), (7 + 2 * F.col("i")).alias("row_nr"), "b", "c", "d", *[F.lit(None).cast("string").alias(c) for c in ("h", *_AMOUNTS)])
    return top.unionByName(low)


@query(with_(ANNUAL, _RECORDS) + "SELECT year, i AS record, b, c, d, h AS label, k AS opened, ah AS committed FROM recs")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-row scan: label and amounts of the top row with the code of the row below; the year comes from the file name."""
    df = C.pair_rows(sheet(spark, sf_dir), first_row=6, top=["h", "k", "ah"], low=["b", "c", "d"], keys=["file"])
    return df.select(year_of_name(F.col("file")).alias("year"), "record", "b", "c", "d", F.col("h").alias("label"), F.col("k").try_cast("double").alias("opened"), F.col("ah").try_cast("double").alias("committed"))


@query(with_(ANNUAL, _RECORDS) + "SELECT year, i AS record, coalesce(d, c, b) AS code, k AS opened, m AS transfer_in, o AS transfer_out, ab AS ceiling, ah AS committed FROM recs")
def extract_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-row scan with the columns of the transfers and of the ceiling as well."""
    df = C.pair_rows(sheet(spark, sf_dir), first_row=6, top=list(_AMOUNTS), low=["b", "c", "d"], keys=["file"])
    return df.select(year_of_name(F.col("file")).alias("year"), "record", F.coalesce("d", "c", "b").alias("code"), *[F.col(letter).try_cast("double").alias(c) for letter, c in _AMOUNTS.items()])


_DEPTH = "CASE WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 WHEN d IS NOT NULL THEN 3 END"


@query(with_(ANNUAL, _RECORDS) + f"SELECT year, i AS record, {_DEPTH} AS depth, CASE {_DEPTH} WHEN 1 THEN 'chapter' WHEN 2 THEN 'programme' ELSE 'line' END AS level FROM recs")
def hierarchy_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and level name from the code column that is given."""
    d = C.depth(["b", "c", "d"])
    return records(spark, sf_dir).select("year", F.col("i").alias("record"), d.alias("depth"), F.element_at(F.array(*map(F.lit, ("chapter", "programme", "line"))), d).alias("level"))


@query(with_(ANNUAL, _RECORDS) + f""", f AS (SELECT year, i, {_DEPTH} AS depth, last_value(b IGNORE NULLS) OVER w AS l1, last_value(c IGNORE NULLS) OVER w AS l2, d FROM recs WINDOW w AS (PARTITION BY year ORDER BY i))
SELECT year, i AS record, l1, CASE WHEN depth >= 2 THEN l2 END AS l2, d AS l3, concat_ws('-', l1, CASE WHEN depth >= 2 THEN l2 END, d) AS series_key FROM f""")
def ffill_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestor codes filled forward without reset, deeper levels masked, and the key of joined codes."""
    df = O.fill_forward(records(spark, sf_dir).withColumn("depth", C.depth(["b", "c", "d"])), ["b", "c"], ["year"], "i")
    l2 = F.when(F.col("depth") >= 2, F.col("c"))
    return df.select("year", F.col("i").alias("record"), F.col("b").alias("l1"), l2.alias("l2"), F.col("d").alias("l3"), F.concat_ws("-", "b", l2, "d").alias("series_key"))


@query(with_(ANNUAL, _RECORDS) + f""", r AS (SELECT *, {_DEPTH} AS depth, sum(CASE WHEN {_DEPTH} < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY year ORDER BY i) AS r2 FROM recs)
SELECT year, i AS record, depth, last_value(b IGNORE NULLS) OVER (PARTITION BY year ORDER BY i) AS l1, CASE WHEN depth >= 2 THEN last_value(c IGNORE NULLS) OVER (PARTITION BY year, r2 ORDER BY i) END AS l2, CASE WHEN depth >= 3 THEN d END AS l3 FROM r""")
def ffill_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestor codes filled forward; a level starts anew under a new higher level."""
    df = O.fill_forward_reset(records(spark, sf_dir).select("year", "i", "b", "c", "d"), ["b", "c", "d"], ["year"], "i")
    return df.select("year", F.col("i").alias("record"), "depth", F.col("b_full").alias("l1"), F.col("c_full").alias("l2"), F.col("d_full").alias("l3"))


@query(with_(ANNUAL, _RECORDS) + """, f AS (SELECT year, i, last_value(b IGNORE NULLS) OVER (PARTITION BY year ORDER BY i) AS l1, h FROM recs) SELECT year, i AS record, l1, h AS label FROM f WHERE l1 NOT IN ('ASIA', 'EUROPE')""")
def exclude_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside two excluded chapters, which their parents' code tells."""
    df = O.fill_forward(records(spark, sf_dir), ["b"], ["year"], "i")
    return df.where(~F.col("b").isin("ASIA", "EUROPE")).select("year", F.col("i").alias("record"), F.col("b").alias("l1"), F.col("h").alias("label"))


@query("SELECT l_partkey AS key, count(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate)) = (SELECT count(DISTINCT year(l_shipdate)) FROM lineitem)")
def stable_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that appear in every year."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.year("l_shipdate").alias("y")).distinct()
    n = df.agg(F.countDistinct("y").alias("total"))
    return df.groupBy("key").agg(F.count("*").alias("years")).crossJoin(F.broadcast(n)).where("years = total").select("key", "years")


@query(with_(FINE) + f"SELECT series_key, count(*) FILTER (year < {TARGET} AND rate IS NOT NULL) AS n_train FROM fine GROUP BY 1 HAVING count(*) FILTER (year < {TARGET} AND rate IS NOT NULL) >= 3 AND count(*) FILTER (year = {TARGET}) = 1")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with three training years or more and exactly one target row."""
    train = F.count_if((F.col("year") < TARGET) & F.col("rate").isNotNull())
    return fine(spark, sf_dir).groupBy("series_key").agg(train.alias("n_train"), F.count_if(F.col("year") == TARGET).alias("n_target")).where("n_train >= 3 AND n_target = 1").select("series_key", "n_train")


@query(with_(ANNUAL) + "SELECT year, round(sum(opened), 4) AS total, round(sum(opened), 4) < 0.5 * (SELECT median(s) FROM (SELECT sum(opened) AS s FROM annual GROUP BY year)) AS partial FROM annual GROUP BY 1")
def partial_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years whose total is less than half the median of the years' totals."""
    return below_median(annual(spark, sf_dir).groupBy("year").agg(F.sum("opened").alias("s")))


def below_median(totals: DataFrame, share: float = 0.5) -> DataFrame:
    """year, total and partial: whether a year's total s is under `share` of the median total. A row is a year."""
    med = totals.agg(F.percentile("s", F.lit(0.5)).alias("m"))
    return totals.crossJoin(F.broadcast(med)).select("year", F.round("s", 4).alias("total"), (F.round("s", 4) < share * F.col("m")).alias("partial"))


@query("SELECT p_partkey, " + X.normal_label_sql("'É' || p_name || '  /  Çà'") + " AS label FROM part")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without accents, marks and case."""
    return table(spark, sf_dir, "part").select("p_partkey", X.normal_label(F.concat(F.lit("É"), "p_name", F.lit("  /  Çà"))).alias("label"))


_NUM = "replace(CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || ' 000,' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0'), '-', '-')"


@query(f"SELECT s_suppkey, {X.parse_number_sql(_NUM)} AS number, {X.parse_number_sql('s_name')} AS not_a_number FROM supplier")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with blanks and decimal commas; text gives null."""
    text = F.concat(F.floor("s_acctbal").cast("string"), F.lit(" 000,"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.parse_number(text).alias("number"), X.parse_number(F.col("s_name")).alias("not_a_number"))


@query("SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS padded, lower(CASE WHEN s_suppkey % 2 = 0 THEN ' Yes ' ELSE 'no' END) LIKE '%yes%' AS flag FROM supplier")
def code_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral floats as integer text, blank codes as null, leading zeros kept, yes and no as flags."""
    df = table(spark, sf_dir, "supplier")
    padded = F.when(F.col("s_suppkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")))
    return df.select("s_suppkey", X.normal_code(F.col("s_suppkey").cast("double")).alias("code"), X.normal_code(padded).alias("padded"), X.truthy(F.when(F.col("s_suppkey") % 2 == 0, F.lit(" Yes ")).otherwise(F.lit("no"))).alias("flag"))


@query(with_(ANNUAL) + "SELECT DISTINCT series_key, split_part(series_key, '-', 1) AS l1, split_part(series_key, '-', 1) || '-' || split_part(series_key, '-', 2) AS prefix, len(string_split(series_key, '-')) AS depth FROM annual")
def key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, prefix and depth of a key."""
    k = F.col("series_key")
    return annual(spark, sf_dir).select("series_key").distinct().select(k, F.split_part(k, F.lit("-"), F.lit(1)).alias("l1"), F.substring_index(k, "-", 2).alias("prefix"), X.level_of_key(k).cast("long").alias("depth"))


@query("SELECT n_name, CAST(regexp_extract('ledger-' || (2000 + n_nationkey) || '.csv', '((?:19|20)[0-9]{2})', 1) AS INT) AS year FROM nation")
def year_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year in a file name."""
    return table(spark, sf_dir, "nation").select("n_name", year_of_name(F.format_string("ledger-%d.csv", 2000 + F.col("n_nationkey"))).alias("year"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'jewels' WHEN p_name LIKE '%widget%' THEN 'parts' ELSE 'other' END AS category, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS code FROM part")
def category_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category by keyword and code by lookup; what is not mapped is null."""
    name = F.lower(F.trim("p_name"))
    codes = F.create_map(*[F.lit(x) for pair in (("SMALL", 0), ("MEDIUM", 1), ("LARGE", 2)) for x in pair])
    return table(spark, sf_dir, "part").select("p_partkey", F.when(name.contains("ring"), "jewels").when(name.contains("widget"), "parts").otherwise("other").alias("category"), F.try_element_at(codes, F.col("p_type")).alias("code"))


@query(with_(FINE) + f""", m AS (SELECT l1, median(rate) AS lm FROM fine GROUP BY 1), g AS (SELECT avg(rate) AS gm FROM fine)
SELECT series_key, year, round(coalesce(CASE WHEN year % 2 = 0 THEN rate END, lm, gm), 6) AS rate FROM fine LEFT JOIN m USING (l1), g""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing rates filled by the group's median, then the overall mean."""
    df = fine(spark, sf_dir)
    m, g = O.quantiles(df, "rate", {"lm": 0.5}, ("l1",)), df.agg(F.avg("rate").alias("gm"))
    return df.withColumn("rate", F.when(F.col("year") % 2 == 0, F.col("rate"))).join(m, "l1", "left").crossJoin(F.broadcast(g)).select("series_key", "year", F.round(F.coalesce("rate", "lm", "gm"), 6).alias("rate"))


@query(with_(FINE) + f"SELECT f.series_key, f.year, round(CASE WHEN f.year = {TARGET} THEN coalesce(p.opened, f.opened) ELSE f.opened END, 4) AS opened FROM fine f LEFT JOIN (SELECT series_key, opened FROM fine WHERE year = {TARGET - 1} AND opened > 500000) p USING (series_key)")
def update_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one year take a looked-up value where there is one."""
    df = fine(spark, sf_dir)
    look = df.where((F.col("year") == TARGET - 1) & (F.col("opened") > 500000)).select("series_key", F.col("opened").alias("new"))
    return df.join(look, "series_key", "left").select("series_key", "year", F.round(F.when(F.col("year") == TARGET, F.coalesce("new", "opened")).otherwise(F.col("opened")), 4).alias("opened"))


# --- joins --------------------------------------------------------------------------------------------
@query(with_(ANNUAL) + "SELECT series_key, year FROM annual WHERE l2 IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose nation is in a set."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("l2"))
    return annual(spark, sf_dir).join(n, "l2", "left_semi").select("series_key", "year")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query(with_(QUARTERS) + "SELECT coalesce(a.series_key, b.series_key) AS series_key, a.taux AS taux_1998, b.taux AS taux_2000 FROM (SELECT * FROM quarters WHERE year = 1998 AND quarter = 4 AND CAST(series_key AS INT) % 3 <> 0) a FULL JOIN (SELECT * FROM quarters WHERE year = 2000 AND quarter = 4 AND CAST(series_key AS INT) % 5 <> 0) b ON a.series_key = b.series_key")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-end rates of two years side by side, series of either."""
    q = quarters(spark, sf_dir).where("quarter = 4")
    at = lambda y, m: q.where((F.col("year") == y) & (F.col("series_key").cast("int") % m != 0)).select("series_key", F.col("taux").alias(f"taux_{y}"))
    return at(1998, 3).join(at(2000, 5), "series_key", "full")


@query("SELECT series, o_orderkey, o_orderdate FROM (SELECT o_custkey AS series, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order of each customer: a minimum of a struct, which combines before the shuffle, instead of a window."""
    first = F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series")).agg(first).select("series", "f.o_orderkey", "f.o_orderdate")


@query(with_(FINE) + f"SELECT v.series_key, v.year, (SELECT opened FROM fine c WHERE c.series_key = v.series_key AND c.year < v.year AND c.opened > 400000 ORDER BY c.year DESC LIMIT 1) AS credits FROM fine v")
def as_of_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of the latest earlier year that had enough: an as-of lookup as one window, without a join."""
    w = O.before(["series_key"], "year")
    return fine(spark, sf_dir).select("series_key", "year", F.last(F.when(F.col("opened") > 400000, F.col("opened")), ignorenulls=True).over(w).alias("credits"))


@query(with_(FINE) + f"SELECT v.series_key, v.year, count(h.year) AS n, round(avg(h.rate), 6) AS mean_rate FROM fine v JOIN fine h ON h.series_key = v.series_key AND h.year < v.year WHERE v.year >= {TARGET - 2} GROUP BY 1, 2")
def prior_rows_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History before each validation year: an equi-join on the series with the year as residual condition."""
    df = fine(spark, sf_dir)
    v, h = df.where(F.col("year") >= TARGET - 2).select("series_key", "year"), df.select(F.col("series_key").alias("k"), F.col("year").alias("y"), "rate")
    return v.join(h, (F.col("series_key") == F.col("k")) & (F.col("y") < F.col("year"))).groupBy("series_key", "year").agg(F.count("y").alias("n"), F.round(F.avg("rate"), 6).alias("mean_rate"))


@query(with_(ANNUAL) + f", old AS (SELECT l3 AS id, l1 || '|' || l2 || '||' || l3 AS k FROM annual WHERE year = {TARGET - 1}), new AS (SELECT l3 AS id, l1 || '|' || l2 || '||' || l3 AS k FROM annual WHERE year = {TARGET}) SELECT new.k, old.id AS repaired_id FROM new JOIN old USING (k)")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids repaired through a joined text key; one row a key on either side."""
    key = F.concat(F.col("l1"), F.lit("|"), F.col("l2"), F.lit("||"), X.normal_code(F.col("l3")))
    at = lambda y: annual(spark, sf_dir).where(F.col("year") == y).select(key.alias("k"), F.col("l3").alias("id"))
    return at(TARGET).select("k").join(at(TARGET - 1), "k").select("k", F.col("id").alias("repaired_id"))


@query("SELECT CASE WHEN p.p_size = 1 THEN r.r_name ELSE 'NONE' END AS region, p.p_partkey, round(p.p_retailprice / CASE WHEN p.p_size = 1 THEN (SELECT count(*) FROM region) ELSE 1 END, 6) AS share FROM part p LEFT JOIN region r ON p.p_size = 1")
def region_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked row becomes one row for each region with its share. The regions are a fixed short list, folded into an array for the join."""
    names = table(spark, sf_dir, "region").agg(F.collect_list("r_name").alias("rs"))
    df = table(spark, sf_dir, "part").crossJoin(F.broadcast(names)).withColumn("to", F.when(F.col("p_size") == 1, F.col("rs")).otherwise(F.array(F.lit("NONE"))))
    return df.select(F.explode("to").alias("region"), "p_partkey", F.round(F.col("p_retailprice") / F.size("to"), 6).alias("share"))


@query(with_(QUARTERS) + "SELECT year, category, 'T' || quarter AS quarter, round(sum(amount), 4) AS realised FROM quarters GROUP BY 1, 2, 3")
def unpivot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide quarterly sheet turned into rows: one column block a quarter, unpivoted."""
    q = quarters(spark, sf_dir).groupBy("year", "category").pivot("quarter", [1, 2, 3, 4]).agg(F.sum("amount"))
    return C.wide_to_long(q, ["year", "category"], {"T1": "1", "T2": "2", "T3": "3", "T4": "4"}, "quarter", "v").select("year", "category", "quarter", F.round("v", 4).alias("realised"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 7 = 0")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, parsed with a schema."""
    return table(spark, sf_dir, "events").where("event_id % 7 = 0").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(with_(MOVES) + "SELECT series_key, CAST(year AS VARCHAR) AS year_text, printf('committed %.4f of %.4f (%.3f %%)', committed, opened, 100 * committed / opened) AS detail, substr(series_key, 1, 8) || CASE WHEN len(series_key) > 8 THEN '...' ELSE '' END AS short FROM moves WHERE opened > 0")
def detail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as text, details of a flag as a sentence, labels cut to length."""
    df = movements(spark, sf_dir).where("opened > 0")
    text = F.format_string("committed %.4f of %.4f (%.3f %%)", "committed", "opened", 100 * F.col("committed") / F.col("opened"))
    return df.select("series_key", F.col("year").cast("string").alias("year_text"), text.alias("detail"), F.concat(F.substring("series_key", 1, 8), F.when(F.length("series_key") > 8, "...").otherwise("")).alias("short"))


@query("SELECT unnest(['a', 'b', 'c']) AS profile, unnest([0.25, 0.5, 0.25]::DOUBLE[]) AS weight")
def literal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table embedded in the program."""
    return spark.createDataFrame([("a", 0.25), ("b", 0.5), ("c", 0.25)], "profile string, weight double")


@query(with_(MOVES) + "SELECT year, count(*) AS n, count(*) FILTER (opened IS NULL OR opened = 0) AS zero_credits, count(*) FILTER (committed = 0) AS zero_amounts FROM moves GROUP BY 1")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, zero credits and zero amounts by year."""
    return movements(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("opened").isNull() | (F.col("opened") == 0)).alias("zero_credits"), F.count_if(F.col("committed") == 0).alias("zero_amounts"))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column if the table has it, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


@query(with_(ANNUAL) + "SELECT year, series_key, l1, round(opened, 4) AS opened, round(committed, 4) AS committed, round(transfer_in, 4) AS transfer_in, round(transfer_out, 4) AS transfer_out FROM annual")
def workbook_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual panel written to workbooks, a sheet a year and two physical rows a record, and read back from them."""
    rows = annual(spark, sf_dir)
    empty = F.lit(None).cast("double")
    top = F.struct(F.lit(1).alias("_half"), F.col("series_key").alias("A"), F.col("l1").alias("B"), F.round("opened", 4).alias("C"), F.round("committed", 4).alias("D"), empty.alias("E"), empty.alias("F"))
    low = F.struct(F.lit(2).alias("_half"), F.lit(None).cast("string").alias("A"), F.lit(None).cast("string").alias("B"), empty.alias("C"), empty.alias("D"), F.round("transfer_in", 4).alias("E"), F.round("transfer_out", 4).alias("F"))
    ledger = rows.select(F.col("year").cast("string").alias("sheet"), F.col("series_key").alias("_key"), F.explode(F.array(top, low)).alias("r")).select("sheet", "_key", "r.*")
    path = fresh_path(spark, "workbooks")
    write_workbook(ledger, path, "sheet", "_key", "_half")
    cells = read_cells(spark, path, {"A": "string", "B": "string", "C": "string", "D": "string", "E": "string", "F": "string"})
    found = C.pair_rows(cells, first_row=1, top=["A", "B", "C", "D"], low=["E", "F"], keys=["file", "sheet"])
    number = lambda c: F.col(c).cast("double")
    return found.select(F.col("sheet").cast("int").alias("year"), F.col("A").alias("series_key"), F.col("B").alias("l1"), number("C").alias("opened"), number("D").alias("committed"), number("E").alias("transfer_in"), number("F").alias("transfer_out"))
