"""Forecasting methods by name: closed forms over a history, and models fitted on all series of strictly earlier years."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import series as S
from .boosting import Fit, fit_all
from .learners import BOOSTED

#: Features of the pooled model: a number of the series, the year, and lags, mean and slope of earlier years.
POOLED = ("line", "year", "lag1", "lag2", "mean_past", "slope")


@dataclass(frozen=True)
class Closed:
    """column(h, years, target): the forecast for the year `target` from the values h of the years before, one expression."""

    column: Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Fitted:
    """predict(panel, years): series_key, year, predicted of each of the years, by models that learn from strictly earlier rows of the panel (series_key, year, value) alone."""

    predict: Callable[[DataFrame, tuple[int, ...]], DataFrame]


def pooled_rows(panel: DataFrame, ahead: tuple[int, ...] = ()) -> DataFrame:
    """series_key, year, label and POOLED of all rows with two earlier years or more; n: how many. ahead: years to come, whose rows have no label."""
    if ahead:
        grid = panel.groupBy("series_key").agg(F.max("year").alias("last")).select("series_key", F.explode(F.array(*map(F.lit, ahead))).alias("year"), "last").where("year > last")
        panel = panel.select("series_key", "year", "value").unionByName(grid.select("series_key", F.col("year").cast("int").alias("year"), F.lit(None).cast("double").alias("value")))
    own = W.partitionBy("series_key").orderBy("year")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    x, y = (F.col("year") - 2000).cast("double"), F.col("value")
    df = panel.withColumns({"n": F.count(y).over(before), "slope": F.regr_slope(y, x).over(before), "mean_past": F.avg(y).over(before), "lag1": F.lag(y).over(own), "lag2": F.lag(y, 2).over(own)})
    return df.where("n >= 2").select("series_key", "year", y.alias("label"), "n", F.crc32("series_key").cast("double").alias("line"), *POOLED[2:])


def boosted(panel: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """One boosted ensemble a year over all series, trained side by side; rows with three earlier years or more are predicted, not below zero."""
    rows = pooled_rows(panel)
    fits = {str(y): Fit(POOLED, where=F.col("year") < y, how=BOOSTED["pooled"]) for y in years}
    out = None
    for y, model in fit_all(rows, fits, ["series_key", "year"]).items():
        part = model.transform(rows.where((F.col("year") == int(y)) & (F.col("n") >= 3))).where("prediction IS NOT NULL")
        part = part.select("series_key", "year", F.greatest("prediction", F.lit(0.0)).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


METHODS: dict[str, Closed | Fitted] = {name: Closed(lambda h, _years, _target, f=f: f(h)) for name, f in S.METHODS.items()} | {
    "Ridge": Closed(S.ridge),
    "TrendYears": Closed(S.line_at),
    "Boosting": Fitted(boosted),
}


def long_predictions(rows: DataFrame, names: tuple[str, ...], keep: list[str], panel: DataFrame | None = None, years: tuple[int, ...] = ()) -> DataFrame:
    """keep, method, predicted of each of rows (series_key, year, h, hy) by each method.

    Closed forms come from one projection. Fitted ones are joined by series and year; a row that they leave out gets the line over the years. panel (series_key, year, value) and years are for these.
    """
    closed = {n: METHODS[n].column(F.col("h"), F.col("hy"), F.col("year")) for n in names if isinstance(METHODS[n], Closed)}
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.alias("predicted")) for k, v in closed.items()])) if closed else None
    out = rows.select(*keep, stacked.alias("_m")).select(*keep, "_m.method", "_m.predicted") if closed else None
    for n in names:
        if isinstance(METHODS[n], Fitted):
            found = METHODS[n].predict(panel, years)
            part = rows.join(found, ["series_key", "year"], "left").select(*keep, F.lit(n).alias("method"), F.coalesce("predicted", S.line_at(F.col("h"), F.col("hy"), F.col("year"))).alias("predicted"))
            out = part if out is None else out.unionByName(part)
    return out.where("predicted IS NOT NULL")
