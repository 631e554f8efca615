"""State between runs: numbered snapshots of a table, an append-only log, and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished snapshots, ascending; a snapshot whose writing was cut off has no success mark and does not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().removeprefix("v")) for f in found or [])


def write_snapshot(df: DataFrame, folder: str) -> int:
    """Write df as the next snapshot; earlier ones stay as they are."""
    number = max(versions(df.sparkSession, folder), default=0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/v{number}")
    return number


def read_snapshot(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """A snapshot, the latest by default; None if there is none."""
    known = versions(spark, folder)
    if not known or (number is not None and number not in known):
        return None
    return spark.read.parquet(f"{folder}/v{number or known[-1]}")


def changes(new: DataFrame, old: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """key, change, direction of rows in both that moved by `least` or more."""
    o = old.select(key, F.col(value).alias("_old"))
    d = F.col(value) - F.col("_old")
    return new.join(o, key).where(F.abs(d) >= least).select(key, d.alias("change"), F.when(d > 0, "up").otherwise("down").alias("direction"))


def append_log(df: DataFrame, folder: str) -> None:
    """One more part of a JSON log; what is there is never rewritten."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(folder)
