"""Windows and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def ordered(keys: list[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def before(keys: list[str], order: str, last: int | None = None) -> WindowSpec:
    """Strictly earlier rows: all, or the last few."""
    return ordered(keys, order).rowsBetween(W.unboundedPreceding if last is None else -last, -1)


def with_group(df: DataFrame, keys: list[str], *stats: Column) -> DataFrame:
    """Group statistics on each row: aggregated with map-side combine and joined back, so that a group that holds a third of all rows is not one task's window."""
    return df.join(df.groupBy(*keys).agg(*stats), keys)


def minmax(df: DataFrame, scaled: dict[str, str]) -> DataFrame:
    """Columns (name: source) scaled to 0..1 over the whole table; 0 if the source hardly varies, null where it is null. One aggregation for all of them."""
    ends = df.agg(*[f(c).alias(f"_{k}_{name}") for name, c in scaled.items() for k, f in (("lo", F.min), ("hi", F.max))])
    width = lambda name: F.col(f"_hi_{name}") - F.col(f"_lo_{name}")
    unit = {name: F.when(width(name) < 1e-12, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_lo_{name}")) / F.nullif(width(name), F.lit(0.0))) for name, c in scaled.items()}
    return df.crossJoin(F.broadcast(ends)).withColumns(unit).drop(*ends.columns)


def fill_forward(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Each column takes the last value that is not null, without reset."""
    w = ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_forward_reset(df: DataFrame, levels: list[str], keys: list[str], order: str) -> DataFrame:
    """Ancestor codes filled forward; a level starts anew when a higher level changes.

    depth: place of the first level that a row names. A level's group is the run since the last row of smaller depth, counted by a running sum.
    """
    depth = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)) for i, c in enumerate(levels)])
    out = df.withColumn("depth", depth)
    run = ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)
    for i, c in enumerate(levels):
        out = out.withColumn("_run", F.sum(F.when(F.col("depth") < i + 1, 1).otherwise(0)).over(run))
        w = ordered([*keys, "_run"], order).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(f"{c}_full", F.when(F.col("depth") >= i + 1, F.last(c, ignorenulls=True).over(w)))
    return out.drop("_run")


BUCKETS = 64


def ranked_values(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value, upto (rows of the group up to this value) and n (rows of the group), one row a distinct value; nulls are left out.

    Values are cut into buckets by approximate quantiles; where the cuts lie has no bearing on the result. A running sum inside each bucket and one over the small
    table of bucket sizes give exact places, so no task sorts or holds all values. Groups must not be null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    cuts = counts.agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_cuts"))
    cut = counts.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.size(F.filter("_cuts", lambda b: b < F.col(value)))).drop("_cuts")
    within = cut.withColumn("_in", F.sum("_c").over(W.partitionBy("_bucket", *by).orderBy(value)))
    sizes = cut.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_s"))
    before = sizes.select(*by, "_bucket", (F.sum("_s").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy(*by)).alias("n"))
    return within.join(before, [*by, "_bucket"]).select(*by, value, (F.col("_before") + F.col("_in")).alias("upto"), "n")


def quantiles(df: DataFrame, value: str, levels: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by and one column a level: exact quantiles, interpolated between neighbours. One row without `by` (nulls if there are no values)."""
    placed = ranked_values(df, value, by)
    cols = []
    for name, p in levels.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        cols.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*by).agg(*cols)
