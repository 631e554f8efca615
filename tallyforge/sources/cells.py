"""Scans of spreadsheet cells: tables of cells by row number, one column a letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_rows(cells: DataFrame, *, first_row: int, top: list[str], low: list[str], keys: list[str]) -> DataFrame:
    """One record for two physical rows: columns `top` of the first, `low` of the second; record counts from 0. Blank pairs are left out.

    One aggregation by (keys, record): cells of a column that stand twice in a pair give the largest.
    """
    record = F.floor((F.col("row_nr") - first_row) / 2).cast("int")
    is_top = (F.col("row_nr") - first_row) % 2 == 0
    pick = [F.max(F.when(is_top if c in top else ~is_top, F.nullif(F.trim(F.col(c)), F.lit("")))).alias(c) for c in [*top, *low]]
    out = cells.where(F.col("row_nr") >= first_row).groupBy(*keys, record.alias("record")).agg(*pick)
    return out.where(F.coalesce(*[F.col(c) for c in [*top, *low]]).isNotNull())


def depth(codes: list[str]) -> Column:
    """Place of the first code column that is given, from 1; null if none is."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)) for i, c in enumerate(codes)])


def wide_to_long(df: DataFrame, ids: list[str], blocks: dict[str, str], name: str, value: str) -> DataFrame:
    """Columns side by side become rows; blocks: label by column. Missing cells are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(label).alias(name), F.col(f"`{c}`").alias(value)) for label, c in blocks.items()])).alias("_c")
    return df.select(*ids, cells).select(*ids, f"_c.{name}", f"_c.{value}").where(F.col(value).isNotNull())
