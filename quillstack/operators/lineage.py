"""Materialising intermediate rows and numbering rows globally without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillstack-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with the 1-based position of each row in the total order of the columns `order`.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of the
    partitions before it (one count per partition is broadcast), so no task sees more than its range.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialised(rows.withColumns({"_part": F.spark_partition_id(), "_place": place}))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return rows.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
