"""Shared parts of the training-data operators: lineage cuts, sorted runs, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only a local session without one (tests) gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillstack-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise narrow rows in the shared folder and forget the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise wide rows as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    table.stored_at = path
    return table


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table; nothing that still reads it may be evaluated afterwards."""
    if path := getattr(df, "stored_at", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, dropped: DataFrame, doc_id: str, mark: Column) -> DataFrame:
    """`df` without the rows whose doc_id and mark are in `dropped` (doc_id, mark); rows of the same doc_id with another mark stay."""
    name = fresh(df, "mark")
    gone = dropped.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(name)).distinct()
    return df.withColumn(name, mark).join(gone, [doc_id, name], "left_anti").select(df.columns)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose DataFrames are gone; only disk space depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 400_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by key; a table has about `rows` rows or one run."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole[key].to_numpy()
        start = int(np.searchsorted(keys, keys[-1], "left"))
        if start:
            yield whole.slice(0, start)
            held = whole.slice(start).to_batches()
            n = whole.num_rows - start
        rows = max(rows, 2 * n)  # a run longer than a table: look again when it has doubled
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the undirected edges (u, v)."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        keep = a != b
        u, v, a, b = u[keep], v[keep], a[keep], b[keep]
        if not len(u):
            break
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
    return root


def local_stars(nodes: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that aren't it; u and v are positions in `nodes`.

    Stars to the smallest node make overlapping groups send the same pairs, which then count once.
    """
    roots = local_roots(len(nodes), u, v)
    low = nodes.copy()
    np.minimum.at(low, roots, nodes)
    low = low[roots]
    moved = np.flatnonzero(low != nodes)
    return nodes[moved], low[moved]


def local_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of edges (u, v) that span the components of n nodes without a cycle."""
    kept, root, left = np.empty(0, np.int64), np.arange(n), np.arange(len(u))
    while True:
        a, b = root[u[left]], root[v[left]]
        left, high = left[a != b], np.maximum(a, b)[a != b]
        if not len(left):
            return kept
        # One edge from each root to a smaller one.
        kept = np.r_[kept, left[np.unique(high, return_index=True)[1]]]
        root = local_roots(n, u[kept], v[kept])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u long, v long); root is the smallest node reachable.

    Alternates small-star and large-star steps until the edge set stands still.  Minima are pre-aggregated, and
    a hub's edges meet its minimum in an equi-join that adaptive execution can split.  Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    pairs = edges.where(F.col("u") != F.col("v"))
    stars = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _signature(stars)) != before:
        before = now
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        moved = stars.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _signature(stars: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(stars.agg(F.count("*"), F.sum(h)).first())


def arrow_map(df: DataFrame, per_table: Callable[[pa.Table], pa.Table | None], schema: str, key: str, rows: int = 400_000) -> DataFrame:
    """Group by `key`: whole runs of equal keys go through `per_table`, about `rows` rows of whole keys at a time."""

    def run(batches):
        for whole in sorted_runs(batches, key, rows):
            if (out := per_table(whole)) is not None and out.num_rows:
                yield from out.to_batches()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
