"""The tree of path prefixes: nodes, their order, and its drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import numbered


def path_parts(path: Column) -> Column:
    """Segments of a path; an address keeps scheme and host as one segment and its query in the last."""
    text = F.trim(path)
    web = F.rlike(text, F.lit("(?i)^https?://[^/?#]+"))
    root = F.lower(F.regexp_extract(text, "(?i)^(https?)://", 1))
    host = F.regexp_extract(text, "(?i)^https?://([^/?#]+)", 1)
    rest = F.regexp_extract(text, "(?i)^https?://[^/?#]+/?([^?#]*)", 1)
    query = F.regexp_extract(text, r"(?i)^https?://[^/?#]+[^?#]*(\?[^#]+)", 1)
    address = F.array(F.concat(root, F.lit("://"), host))
    address = F.when(rest == "", address).otherwise(F.concat(address, F.split(F.concat(rest, query), "/")))
    plain = F.filter(F.split(F.regexp_replace(text, "/+", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.when(web, address).otherwise(plain)


def tree_nodes(paths: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per distinct prefix: path (array), parent, name, depth, is_dir, rank among its siblings, is_last.

    Directories come before files, then names in byte order.  Ranks are per directory.
    """
    whole = paths.select(F.col(parts).alias("p")).where(F.size("p") > 0).distinct()
    prefixes = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.slice("p", 1, k).alias("path"), (k < F.size("p")).alias("inner")))).alias("n"))
    nodes = prefixes.groupBy(F.col("n.path").alias("path")).agg(F.max("n.inner").alias("is_dir"))
    parent = F.slice("path", 1, F.size("path") - 1)
    nodes = nodes.select("path", parent.alias("parent"), F.element_at("path", -1).alias("name"), F.size("path").cast("long").alias("depth"), "is_dir")
    # Ranks from one numbering of all nodes, so that a directory with very many children is no single task.
    placed = numbered(nodes, [F.col("parent"), ~F.col("is_dir"), F.col("name")], "_n")
    bounds = placed.groupBy("parent").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    joined = placed.join(bounds, "parent")
    return joined.select("path", "parent", "name", "depth", "is_dir", (F.col("_n") - F.col("_first") + 1).alias("rank"), (F.col("_n") == F.col("_last")).alias("is_last"))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """Nodes with their drawn line and their place (array of ancestor ranks, which orders the drawing)."""
    single = nodes.where("depth = 1").agg((F.count("*") == 1).alias("single"))
    deep = nodes.select("path", "depth", F.explode(F.sequence(F.lit(1), F.col("depth").cast("int"))).alias("k")).withColumn("above", F.slice("path", 1, F.col("k")))
    above = nodes.select(F.col("path").alias("above"), F.col("rank").alias("r"), F.col("is_last").alias("l"))
    chain = F.array_sort(F.collect_list(F.struct("k", "r", "l")))
    placed = deep.join(above, "above").groupBy("path").agg(chain.alias("chain"))
    rows = nodes.join(placed, "path").join(F.broadcast(single), how="cross")
    skip = F.when(F.col("single"), 1).otherwise(0)
    bars = F.transform(F.filter("chain", lambda x: (x["k"] > skip) & (x["k"] < F.col("depth"))), lambda x: F.when(x["l"], "    ").otherwise("│   "))
    joint = F.when(F.col("single") & (F.col("depth") == 1), "").otherwise(F.when(F.col("is_last"), "└── ").otherwise("├── "))
    line = F.concat(F.array_join(bars, ""), joint, "name", F.when(F.col("is_dir"), "/").otherwise(""))
    return rows.select("path", "depth", "is_dir", F.transform("chain", lambda x: x["r"]).alias("place"), line.alias("line"))
