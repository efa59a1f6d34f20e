"""Sections, indices and totals of ordered items.

Items have item_seq (a total order), kind ('section', 'file', 'prompt', 'tree', 'meta', 'failure') and for files a size
(-1: unknown).  Positions come from a range-partitioned numbering and equi-joins, never from a window over everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import size_tokens
from .lineage import numbered


def plan_totals(items: DataFrame, tokens: Callable = size_tokens) -> DataFrame:
    """One row: total_files, total_size, size_unknown, token_estimate.  Reads sizes only, never content; `tokens` estimates by size."""
    size = F.col("size")
    return items.where("kind = 'file'").agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(F.when(size >= 0, size)), F.lit(0)).cast("long").alias("total_size"),
        F.coalesce(F.max(size < 0), F.lit(False)).alias("size_unknown"),
        F.coalesce(F.sum(tokens(size)), F.lit(0)).cast("long").alias("token_estimate"),
    )


def section_totals(items: DataFrame, key: str = "section") -> DataFrame:
    """Per section: total_files, total_size (unknown sizes add nothing)."""
    size = F.when(F.col("size") >= 0, F.col("size"))
    return items.where("kind = 'file'").groupBy(key).agg(F.count("*").alias("total_files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"))


def with_sections(items: DataFrame, order: list) -> DataFrame:
    """Items with item_seq (from 1), section (index), is_implicit and file_index.

    Sections are numbered from 0 if the first item starts one; else an implicit section 0 comes first.  The sections
    before an item are counted by an as-of join that is an equi-join: items are numbered among the section starts.
    """
    rows = numbered(items, order, "item_seq")
    starts = numbered(rows.where("kind = 'section'").select("item_seq"), [F.col("item_seq")], "number")
    bounds = starts.select(F.col("item_seq").alias("from"), (F.col("number") - 1).alias("number"))
    after = starts.select((F.col("item_seq")).alias("to"), (F.col("number") - 2).alias("number"))
    spans = bounds.join(after, "number", "left").select("number", "from", "to")
    # An item's section is found per block of positions, so the range condition runs on equal blocks only.
    block = 4096
    last = F.coalesce(F.col("to") - 1, F.lit(1 << 62))
    top = rows.agg(F.max("item_seq").alias("top"))
    spans = spans.join(F.broadcast(top), how="cross").withColumn("last", F.least(last, F.col("top")))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor(F.col("last") / block))))
    keyed = rows.withColumn("block", F.floor(F.col("item_seq") / block))
    joined = keyed.join(spans, (keyed.block == spans.block) & (keyed.item_seq >= spans["from"]) & (keyed.item_seq <= spans["last"]), "left").drop("block", "from", "to", "last", "top")
    first = rows.where("item_seq = 1").select((F.col("kind") == "section").alias("explicit"))
    joined = joined.join(F.broadcast(first), how="cross")
    section = F.coalesce(F.col("number") + F.when(F.col("explicit"), 0).otherwise(1), F.lit(0))
    return joined.select("*", section.cast("long").alias("section"), F.col("number").isNull().alias("is_implicit")).drop("number", "explicit")


def with_file_index(items: DataFrame) -> DataFrame:
    """Adds file_index (over all), section_file_index, section_files and (of known sizes, if there is a size) section_size to the file rows of with_sections() items.

    The other rows have their section's files and size.
    """
    files = numbered(items.where("kind = 'file'"), [F.col("item_seq")], "file_index")
    known = [F.coalesce(F.sum(F.when(F.col("size") >= 0, F.col("size"))), F.lit(0)).cast("long").alias("section_size")] if "size" in items.columns else []
    first = files.groupBy("section").agg(F.min("file_index").alias("_first"), F.count("*").alias("section_files"), *known)
    files = files.join(first, "section").withColumn("section_file_index", F.col("file_index") - F.col("_first") + 1).drop("_first")
    others = items.where("kind != 'file'").join(first.drop("_first"), "section", "left")
    none = [F.lit(None).cast("long").alias(c) for c in ("file_index", "section_file_index")]
    return files.unionByName(others.select("*", *none))


def separators(items: DataFrame) -> DataFrame:
    """Adds sep_before to items with item_seq, section and is_compact: what the layout writes before each item.

    Within a section two compact items are parted by one line break, other items by two; a new section has two line
    breaks before it.  A section's title counts as an item that isn't compact.
    """
    before = items.select((F.col("item_seq") + 1).alias("item_seq"), F.col("section").alias("_section"), F.coalesce("is_compact", F.lit(False)).alias("_compact"))
    joined = items.join(before, "item_seq", "left")
    gap = (
        F.when(F.col("_section").isNull(), "")
        .when(F.col("_section") != F.col("section"), "\n\n")
        .when(F.col("_compact") & F.coalesce("is_compact", F.lit(False)), "\n")
        .otherwise("\n\n")
    )
    return joined.withColumn("sep_before", gap).drop("_section", "_compact")
