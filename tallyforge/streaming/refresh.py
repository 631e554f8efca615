"""Forecasts that follow new facts: the values of each series are kept as state, and only series that a batch touches are forecast anew.

The state of a series is its sums by year, so its size is the number of years and not of facts. The facts of a batch come to their series in Arrow batches,
so a series with very many of them is summed piece by piece. Late facts are added to the year they belong to, and a correction is a fact with a negative amount. What is given on is the collapsed history, so the forecasts are the
same expressions as those of the batch queries. State lives in the stream's checkpoint; a lost executor costs the batch it was in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.methods import METHODS, Closed

HISTORY = "series_key string, years array<int>, h array<double>"


def histories(facts: DataFrame) -> DataFrame:
    """series_key, years and h (sums by year to four decimals, in order) of each series that the batch touches. facts: a stream of series_key, year, value.

    Facts without series, year or value are left out.
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        years, sums = state.get if state.exists else ([], [])
        known = dict(zip(years, sums, strict=True))
        for pdf in batches:
            for year, value in zip(pdf["year"].tolist(), pdf["value"].tolist(), strict=True):
                known[year] = known.get(year, 0.0) + value
        years = sorted(known)
        state.update((years, [known[y] for y in years]))
        yield pd.DataFrame({"series_key": [key[0]], "years": [years], "h": [[round(known[y], 4) for y in years]]})

    clean = facts.select("series_key", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value")).dropna()
    return clean.groupBy("series_key").applyInPandasWithState(update, HISTORY, "years array<int>, sums array<double>", "update", GroupStateTimeout.NoTimeout)


def forecasts(facts: DataFrame, names: tuple[str, ...], target: int) -> DataFrame:
    """series_key, n (years before the target) and a column for each closed-form method: the forecast of the target year from the years before it, of each series that the batch touches."""
    open_ = [n for n in names if not isinstance(METHODS[n], Closed)]
    if open_:
        raise ValueError(f"not closed forms, so they change with every other series: {', '.join(open_)}")
    past = F.filter(F.arrays_zip("years", "h"), lambda x: x["years"] < target)
    df = histories(facts).withColumn("past", past).where(F.size("past") > 0)
    df = df.select("series_key", F.transform("past", lambda x: x["h"]).alias("h"), F.transform("past", lambda x: x["years"]).alias("hy"))
    return df.select("series_key", F.size("h").alias("n"), *[METHODS[n].column(F.col("h"), F.col("hy"), F.lit(target)).alias(n) for n in names])


def keep_latest(changed: DataFrame, path: str, checkpoint: str):
    """Start a stream that appends each batch's forecasts under path, with the number of the batch; `latest` reads them. A batch that runs again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The last forecasts of each series, from what keep_latest has written: one aggregation."""
    columns = [c for c in table.columns if c not in ("series_key", "batch")]
    last = table.groupBy("series_key").agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return last.select("series_key", *[F.col(f"r.{c}").alias(c) for c in columns])
