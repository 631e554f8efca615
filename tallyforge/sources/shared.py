"""Tables written once to the folder that driver and executors share, so that what reads them several times does not compute them several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths that this process has given out and not deleted, by application.
_given: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under a temporary folder where all runs in one process and it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tallyforge-"))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_written(spark: SparkSession) -> int:
    """Delete all that was written under fresh paths so far; returns how many paths there were. Results that read them must have been written before: queries are lazy."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write df to a fresh path and return it read back. A lost executor costs a reread."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
