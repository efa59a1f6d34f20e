"""Files that arrive in a folder, rendered as they come.  Beyond batch bundles, but of the same stateless steps.

Every step of a file's way (read, classify, convert, reduce, render) is a map, so a stream runs it unchanged; totals per
time window keep state that the watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import count_lines, token_estimate
from ..operators import slicing
from ..plans.profiles import profile_for

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that appear in a folder: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)


def render_stream(files: DataFrame, profile: str = "markdown", first: int = -1, last: int = 0) -> DataFrame:
    """path, ts, size, rows, tokens and item (each file's text in the profile) of a stream or table of files."""
    from ..functions.text import is_binary

    p = profile_for(profile)
    binary = is_binary(F.col("content"))
    text = F.when(binary, "").otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    rows = files.select(
        "path", F.col("modificationTime").alias("ts"), F.col("length").alias("size"), text.alias("text"), binary.alias("is_binary"),
        F.lit(1).alias("file_index"), F.lit(1).alias("section_file_index"), F.lit(1).alias("section_files"), F.lit(0).alias("section"), F.lit(False).alias("is_estimate"),
        F.lit(False).alias("is_image"), none("string").alias("read_error"), none("string").alias("skeleton_mode"), none("string").alias("data_uri"),
    )
    rows = rows.withColumns(
        {
            "language": names.detect_language(F.col("path"), F.col("text")),
            "rows": count_lines(F.col("text")),
            "content": slicing.excerpt(F.col("text"), first, last),
            "is_compact": slicing.is_compact(F.col("text"), first, last) & ~F.col("is_binary"),
        }
    )
    return rows.select("path", "ts", "size", "rows", p.file().alias("item")).withColumn("tokens", token_estimate(F.col("item")))


def window_totals(rendered: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files, bytes, rows and tokens per window of modification time; files later than the watermark are left out."""
    by = rendered.withWatermark("ts", late).groupBy(F.window("ts", width))
    return by.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))


def append_bundle(rendered: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends each trigger's items, by path, as text part files."""

    def write(batch: DataFrame, number: int) -> None:
        ordered = batch.repartitionByRange("path").sortWithinPartitions("path")
        ordered.select(F.concat("item", F.lit("\n")).alias("value")).write.mode("overwrite").text(f"{folder}/batch={number:08d}")  # a repeated batch replaces itself

    return rendered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
