"""python -m tallyforge TABLES OUT QUERY...: run queries over a folder of tables and write each result as Parquet under OUT."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    parser.add_argument("tables")
    parser.add_argument("out")
    parser.add_argument("queries", nargs="+", metavar="QUERY")
    parser.add_argument("--target-year", type=int, help="year that back-tests hold out and forecasts are for (2000)")
    parser.add_argument("--horizon", type=int, help="years that forecasts over several years look ahead (3)")
    parser.add_argument("--methods", help="methods that back-tests compare, with commas (Mean3,Median,Naive,Trend)")
    given = parser.parse_args(args)
    for name in ("target_year", "horizon", "methods"):
        if getattr(given, name) is not None:
            os.environ[f"TALLYFORGE_{name.upper()}"] = str(getattr(given, name))
    from .catalog import QUERIES  # reads the settings
    from .sources.shared import clear_written

    unknown = sorted(set(given.queries) - set(QUERIES))
    if unknown:
        parser.error(f"no query is called {', '.join(unknown)}")
    spark = SparkSession.builder.appName("tallyforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in given.queries:
        QUERIES[name](spark, given.tables).write.mode("overwrite").parquet(f"{given.out}/{name}")
        clear_written(spark)  # the result is there, so what it was read from can go
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
