"""Forecasts that follow new facts: after three increments they are those of one run over all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import methods
from tallyforge.streaming import refresh

NAMES = ("Mean3", "Naive", "Ridge", "SES", "TrendYears")


def test_three_increments_give_the_full_run(spark, tmp_path):
    rows = [(f"s{i % 11}", 1990 + (i * 7) % 10, float((i * 37) % 101) + i / 8) for i in range(300)] + [("s3", 1995, -20.0), (None, 1995, 1.0), ("s4", None, 1.0), ("new", 1999, 5.0)]
    schema = "series_key string, year int, value double"
    src, out, check = (str(tmp_path / n) for n in ("facts", "out", "check"))
    touched = []
    for part, (lo, hi) in enumerate(((0, 120), (120, 240), (240, len(rows)))):
        some = rows[lo:hi] if part != 1 else [r for r in rows[lo:hi] if r[0] in ("s1", "s2")]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(schema).json(src)
        query = refresh.keep_latest(refresh.forecasts(stream, NAMES, 1999), out, check)
        assert query.awaitTermination(120)
        written = spark.read.parquet(out)
        last = written.agg(F.max("batch")).first()[0]
        touched.append({r.series_key for r in written.where(F.col("batch") == last).collect()})
    assert touched[1] == {"s1", "s2"}  # only what has changed is forecast again
    facts = spark.read.schema(schema).json(src).dropna()
    sums = facts.groupBy("series_key", "year").agg(F.round(F.sum("value"), 4).alias("v")).where("year < 1999")
    h = sums.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("year", "v"))).alias("z")).select("series_key", F.transform("z", lambda x: x["v"]).alias("h"), F.transform("z", lambda x: x["year"]).alias("hy"))
    want = {r.series_key: r for r in h.select("series_key", F.size("h").alias("n"), *[methods.METHODS[m].column(F.col("h"), F.col("hy"), F.lit(1999)).alias(m) for m in NAMES]).collect()}
    got = {r.series_key: r for r in refresh.latest(spark.read.parquet(out)).collect()}
    assert got.keys() == want.keys() and len(got) == 11  # "new" has no year before the target
    for k, r in got.items():
        assert r.n == want[k].n and all(r[m] == pytest.approx(want[k][m], rel=1e-9) for m in NAMES)


def test_fitted_methods_are_refused(spark):
    with pytest.raises(ValueError, match="Boosting"):
        refresh.forecasts(spark.createDataFrame([], "series_key string, year int, value double"), ("Naive", "Boosting"), 2000)
