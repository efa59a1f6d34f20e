"""Union of row ranges per group, and the gaps between kept rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per key, half-open ranges joined where they overlap or touch; empty ranges vanish."""
    by = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col(start) > before, F.lit(True)), 1).otherwise(0)
    rows = ranges.where(F.col(start) < F.col(end)).withColumn("_new", new)
    rows = rows.withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def elisions(rows: DataFrame, key: str, row: str = "row") -> DataFrame:
    """Kept rows with elided_before: whether source rows were left out since the kept row before."""
    before = F.lag(row).over(Window.partitionBy(key).orderBy(row))
    return rows.withColumn("elided_before", F.coalesce(F.col(row) != before + 1, F.lit(False)))
