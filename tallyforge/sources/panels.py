"""Panels over the star-schema tables.

Three to six columns of the fact table are read. Where the key is a supplier, facts are aggregated by it first (map-side combine) and the small dimension
rows are joined afterwards; part types are joined before the aggregation, as an aggregate by part and supplier would be about as large as the facts. A range of
years is a range of ship dates, so row groups outside it are not read. Amounts are rounded to four decimals, which is exact for sums of prices times two-decimal rates, so every engine sees the same input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..settings import TARGET



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(value: Column, when: Column | None = None) -> Column:
    """Sum rounded to four decimals, of the rows where `when` holds."""
    return F.round(F.sum(value if when is None else F.when(when, value).otherwise(F.lit(0.0))), 4)


def _year() -> Column:
    return F.year("l_shipdate").cast("int")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier key with region (l1), nation (l2) and supplier (l3)."""
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("k"), F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.col("s_suppkey").cast("string").alias("l3"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual panel by supplier: year, l1..l3, series_key, opened, transfer_in, transfer_out, committed, ceiling."""
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), _year().alias("year")).agg(
        total(price).alias("opened"),
        total(price * F.col("l_tax") * 10, flag == "R").alias("transfer_in"),
        total(price * F.col("l_discount") * 5, flag == "A").alias("transfer_out"),
        total(2 * price * (1 - F.col("l_discount")), F.col("l_linestatus") == "F").alias("committed"),
    )
    out = facts.join(geography(spark, sf_dir), "k")
    return out.select("year", "l1", "l2", "l3", F.concat_ws("-", "l1", "l2", "l3").alias("series_key"), "opened", "transfer_in", "transfer_out", "committed", F.round(F.col("opened") + F.col("transfer_in") - F.col("transfer_out"), 4).alias("ceiling"))


def between(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Line items shipped from the year `since` on and before the year `until`."""
    day = lambda y: F.lit(f"{y}-01-01").cast(df.schema["l_shipdate"].dataType)  # noqa: E731  the column's own type, or the comparison is not pushed down
    if since is not None:
        df = df.where(F.col("l_shipdate") >= day(since))
    return df if until is None else df.where(F.col("l_shipdate") < day(until))


def fine(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Finer annual series by supplier and part type: year, series_key, l1 (type), l2 (supplier), opened, committed, rate. Years: since to until - 1."""
    price = F.col("l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    li = between(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_linestatus"), since, until)
    out = li.join(part, li.l_partkey == part.p_partkey).groupBy(_year().alias("year"), F.col("p_type").alias("l1"), F.col("l_suppkey").cast("string").alias("l2")).agg(total(price).alias("opened"), total(price * (1 - F.col("l_discount")), F.col("l_linestatus") == "F").alias("committed"))
    return out.select("year", F.concat_ws("-", "l1", "l2").alias("series_key"), "l1", "l2", "opened", "committed", rate().alias("rate"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with large transfers, by supplier and part type, complete years: year, series_key, l1, l2, opened, transfer_in, transfer_out, committed, ceiling."""
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    li = between(table(spark, sf_dir, "lineitem"), None, TARGET + 1)
    out = li.join(part, li.l_partkey == part.p_partkey).groupBy(_year().alias("year"), F.col("p_type").alias("l1"), F.col("l_suppkey").cast("string").alias("l2")).agg(
        total(1.5 * price, flag == "N").alias("opened"),
        total(0.5 * price, flag == "R").alias("transfer_in"),
        total(0.4 * price, flag == "A").alias("transfer_out"),
        total(price * (1 - F.col("l_discount")), F.col("l_linestatus") == "F").alias("committed"),
    )
    return out.select("year", F.concat_ws("-", "l1", "l2").alias("series_key"), "l1", "l2", "opened", "transfer_in", "transfer_out", "committed", F.round(F.col("opened") + F.col("transfer_in") - F.col("transfer_out"), 4).alias("ceiling"))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly panel by supplier: category (region), series_key, year, quarter, amount, annual, taux (cumulative share of the year, six decimals)."""
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), _year().alias("year"), F.quarter("l_shipdate").cast("int").alias("quarter")).agg(total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), total(F.col("l_extendedprice")).alias("lf"))
    by_year = W.partitionBy("k", "year")
    out = facts.withColumn("annual", F.round(F.sum("lf").over(by_year), 4)).withColumn("taux", F.round(F.sum("amount").over(by_year.orderBy("quarter")) / F.col("annual"), 6))
    return out.join(geography(spark, sf_dir), "k").select(F.col("l1").alias("category"), F.col("l3").alias("series_key"), "year", "quarter", "amount", "annual", "taux")


def rate(num: str = "committed", den: str = "opened") -> Column:
    """num / den where den is positive, else null."""
    return F.when(F.col(den) > 0, F.col(num) / F.col(den))
