"""Operator 7, embedding near-dedup: subspace pigeonhole join.

Unit vectors with cosine >= t are at a squared distance of at most D = 2 - 2t.  After a fixed random rotation the
coordinates are cut into blocks; a linked pair is within D * (block's dimensions / all dimensions) in one block at
least.  Each block is range-joined under that budget, and the union of what the blocks let through is verified by the
exact cosine, in double precision.

Inside a block the range join compares tile against tile, as products of small matrices.  A grid or pivots don't help
there: a block's radius is as wide as the spread of vectors without structure, so that cells wide enough for it hold
nearly everything (see README for figures).  So each pair of vectors of one label is looked at once, which grows with the
square of a label's size; the blocks only save the verification.

Equal vectors are one class with a multiplicity.  A label's classes are dealt out as pairs of chunks of CHUNK numbers,
so a task holds two chunks at most, however large the label is.  Tasks return link counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, cut, local_stars, table

COSINE = 0.93
BLOCK_DIMS = 16
#: Numbers (vectors times dimensions) that are compared in one piece.
CHUNK = 1 << 19
TILE = 256


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int) -> list[tuple[int, int]]:
    return [(a, min(dims, a + BLOCK_DIMS)) for a in range(0, dims, BLOCK_DIMS)]


def near_pairs(vectors: np.ndarray, part: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(u, v, how many were verified): positions u < v of linked pairs of rows; unless `same`, only of rows of different parts."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]  # neither squares nor products leave the range of doubles
    length = np.sqrt((scaled * scaled).sum(1))
    n, dims = vectors.shape
    rotated = (scaled / length[:, None]) @ rotation(dims)
    blocks = _blocks(dims)
    norms = [(rotated[:, a:b] ** 2).sum(1) for a, b in blocks]
    us, vs, verified = [], [], 0
    for i in range(0, n, TILE):
        end = min(n, i + TILE)
        near = np.zeros((end - i, n - i), bool)
        for (a, b), norm in zip(blocks, norms):
            apart = rotated[i:end, a:b] @ rotated[i:, a:b].T
            apart *= -2
            apart += norm[i:end, None]
            apart += norm[None, i:]
            near |= apart <= (2 - 2 * cosine) * (b - a) / dims + 1e-9
        u, v = np.nonzero(near)
        keep = u < v if same else (u < v) & (part[u + i] != part[v + i])
        u, v = u[keep] + i, v[keep] + i
        verified += len(u)
        for at in range(0, len(u), 1 << 16):
            x, y = u[at : at + (1 << 16)], v[at : at + (1 << 16)]
            hit = (scaled[x] * scaled[y]).sum(1) / (length[x] * length[y]) >= cosine
            us.append(x[hit])
            vs.append(y[hit])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs]), verified


def _compare(run: pa.Table, cosine: float) -> pa.Table:
    """Link counts (kind 0: node, count) and spanning edges (kind 1: node, other) of runs of chunk pairs."""
    key = run["key"].to_numpy()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[first[1:], len(key)]
    node, mult = run["node"].to_numpy(), run["mult"].to_numpy()
    part, same = run["part"].to_numpy(), run["same"].to_numpy(zero_copy_only=False)
    vectors = run["embedding"].combine_chunks()
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    kinds, nodes, others = [], [], []
    for s, e in zip(first, ends):
        u, v, _ = near_pairs(flat[offsets[s] : offsets[e]].reshape(e - s, -1), part[s:e], bool(same[s]), cosine)
        if not len(u):
            continue
        count = np.zeros(e - s, np.int64)
        np.add.at(count, u, mult[s + v])
        np.add.at(count, v, mult[s + u])
        some = np.flatnonzero(count)
        moved, low = local_stars(node[s:e], u, v)
        kinds += [np.zeros(len(some), np.int32), np.ones(len(moved), np.int32)]
        nodes += [node[s + some], moved]
        others += [count[some], low]
    none = np.empty(0, np.int64)
    return pa.table({"kind": np.concatenate([none.astype(np.int32), *kinds]), "node": np.concatenate([none, *nodes]), "other": np.concatenate([none, *others])})


def embedding_groups(rows: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, for columns vec_id, embedding, label.

    A row whose vec_id or label is null, or whose vector is null, empty, zero or holds a null or non-finite
    component, links with nothing; neither do vectors of different lengths.  Rows that repeat a vec_id count as
    separate vectors with one id.  Empty tables give empty results; other columns are neither read nor returned.
    """
    good = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    digest = F.concat_ws("-", F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), F.reverse("embedding"), "label"))
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = cut(source.select("vec_id", "label", "embedding", F.when(F.coalesce(good, F.lit(False)), digest).alias("class")))
    classes = cut(
        keyed.where("class IS NOT NULL").groupBy("class").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"),
            F.first(F.xxhash64("label", F.size("embedding"))).alias("g"),
        )
    )
    slim = classes.select("g", "node", "mult", "embedding")
    pieces = cut(slim.groupBy("g").agg(F.ceil(F.sum(F.size("embedding").cast("long")) / chunk).cast("int").alias("pieces")))
    part = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    dealt = slim.join(pieces, "g").withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("part", "with"), F.greatest("part", "with")
    dealt = dealt.select(F.xxhash64("g", low, high).alias("key"), "part", (low == high).alias("same"), "node", "mult", "embedding")
    found = cut(arrow_map(dealt, lambda run: _compare(run, cosine), "kind int, node long, other long", "key", 8192))
    links = found.where("kind = 0").groupBy("node").agg(F.sum("other").alias("links"))
    roots = connected_components(found.where("kind = 1").select(F.col("node").alias("u"), F.col("other").alias("v")))
    c = classes.select("class", "node", "mult").join(links, "node", "left").join(roots, "node", "left")
    c = c.select("class", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = keyed.select("vec_id", "class").join(c, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT DISTINCT u AS node, u AS seen FROM p UNION SELECT r.node, p.v FROM r JOIN p ON r.seen = p.u),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT u AS node, count(*) AS n_links FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id IS NOT DISTINCT FROM coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.node = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
