"""Shared scratch tables: lineage is cut by writing to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables written within each open passing(), innermost last: path to table.
_open: list[dict[str, DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: executors can't read each other's disks")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tallyforge-"))
    return root.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Cap the rows of an Arrow batch for this session: a Python worker holds a batch of whole texts at a time, and many are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier call returned."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the table read back.

    A lost executor then costs a reread, never a recomputation, and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1][path] = out
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables materialised inside are deleted at the end, except those put on the list that this gives.

    What is kept counts for the passing() around this one, if there is one. After an error all of them go.
    """
    keep: list[DataFrame] = []
    _open.append({})
    done = False
    try:
        yield keep
        done = True
    finally:
        for path, table in _open.pop().items():
            if not (done and any(table is k for k in keep)):
                drop(spark, path)
            elif _open:
                _open[-1][path] = table


def drop(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
