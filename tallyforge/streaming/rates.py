"""Event rates as a stream: windows with a watermark, written once for each run over what has arrived."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum of values by event type and window; events later than the watermark are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")


def run_once(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> list[Row]:
    """Drive a plan over the events that are there, to its end, and return what it wrote."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = f"run_{uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = plan(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()
