"""First-of operators on ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the smallest `order`; pre-aggregated, so a hot key costs a row per task."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(rows.columns)


def shallowest(names: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Per name all paths of the least depth, with their number as `candidates` (more than one is ambiguous)."""
    deep = names.withColumn("_depth", F.size(F.split(F.col(path), "/")) - 1)
    paths = deep.groupBy(name, "_depth").agg(F.collect_set(path).alias("paths"))
    least = paths.groupBy(name).agg(F.min_by("paths", "_depth").alias("paths"))
    return least.select(name, F.explode(F.array_sort("paths")).alias(path), F.size("paths").cast("long").alias("candidates"))
