"""File sources and sinks: delimited text, JSON, file names, columns found by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One separator for what is written and read.
SEPARATOR = ","


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = SEPARATOR) -> DataFrame:
    """Delimited text with a header and a fixed schema (codes stay strings); a byte order mark is dropped by the reader, empty fields are null."""
    return spark.read.csv(path, header=True, schema=schema, sep=separator, encoding="UTF-8", enforceSchema=True, nullValue="")


#: What some spreadsheet programs want at the beginning of a UTF-8 file.
MARK = "\ufeff"


def write_delimited(df: DataFrame, path: str, separator: str = SEPARATOR, mark: bool = False) -> None:
    """Delimited text with a header. mark: each file begins with a byte order mark, as part of its first column's name."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], MARK + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, sep=separator)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A report of several sheets: one folder of Parquet files each."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{safe_name(name)}")


def sheet_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a report's sheets, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def read_sheet(spark: SparkSession, folder: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One sheet of a report by its name; schema: the columns to read and their types (codes as strings), a column that is missing or no such value is null."""
    names = sheet_names(spark, folder)
    if safe_name(name) not in names:
        raise ValueError(f"no sheet is called {name}: {names}")
    df = spark.read.parquet(f"{folder}/{safe_name(name)}")
    if schema is None:
        return df
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def read_many(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All files of a folder whose names match a glob, with the year in their name."""
    df = spark.read.schema(schema).option("pathGlobFilter", pattern).csv(folder, header=True)
    return df.withColumn("year", year_of_name(F.col("_metadata.file_name")))


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of numbers as rows: key, value."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))


def year_of_name(name: Column) -> Column:
    """The first year (20xx or 19xx) in a file name, null if there is none."""
    return F.nullif(F.regexp_extract(name, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def safe_name(name: str) -> str:
    return re.sub(r"[^\w.-]+", "_", name)


def find_column(df: DataFrame, pattern: str) -> str:
    """The first column whose name matches, letters in either case."""
    for c in df.columns:
        if re.search(pattern, c, re.IGNORECASE):
            return c
    raise ValueError(f"no column matches {pattern}: {df.columns}")


def first_that_exists(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that is there, by Hadoop's file system."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    return None
