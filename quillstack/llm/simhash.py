"""Operator 3, SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint is a row of eight positional bytes.  Two fingerprints that differ in at most three bits share at least
five of them, the guaranteed minimum.  The index lists distinct fingerprints under the bytes of four positions, for each
of the 14 sets of four whose numbers add up to nothing in binary without carry: every five positions hold exactly one
such set, so each pair with the minimum meets in a list.  Pairs that meet share four bytes; the tally of all their shared
bytes then decides, and what reaches the minimum is verified by its differing bits.

Lists are sorted runs; a list gives a spanning forest of its links, never all pairs, and a comparison is skipped once
both sides are known to be connected.  Apart from near copies, a list holds about the 2**32nd part of all distinct
fingerprints.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, cut, local_forest, local_stars, release, table, without
from .shingle_join import near_components

#: Four of the eight positions; of the numbers 0 to 7, those whose exclusive or is zero.
QUADRUPLES = tuple(x for x in combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0)
#: At most so many bits differ, so at least 8 - BITS bytes are shared.
BITS = 3
#: For near copies: pairs of positions inside either half.  Every three positions hold one, so that all pairs up to
#: 8 - NEAR_SHARED bits meet; of those that meet, fingerprints up to NEAR_BITS apart (expected at similarity 0.8) are candidates.
HALVES = tuple(x for x in combinations(range(8), 2) if x[0] // 4 == x[1] // 4)
NEAR_SHARED, NEAR_BITS = 3, 10
BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes):
    """Lists of words of `data`, about a megabyte at a time, so that memory doesn't follow a text's length."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + BLOCK)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)


def set_fingerprint(hashes: np.ndarray) -> int:
    """simhash() of a set of shingles, as a signed long: each counts once, so equal sets have equal fingerprints."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16384):
        counts += bit_counts(hashes[i : i + 16384])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(data: bytes, shingle: int = 3) -> int:
    """64 bits from XXH64 (seed 42) of each shingle: a bit is set if it is in over half of them."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(shingles):
        nonlocal total, counts
        for i in range(0, len(shingles), 16384):
            h = np.array([digest(s, 42) for s in shingles[i : i + 16384]], np.uint64)
            total += len(h)
            counts += bit_counts(h)

    for words in word_blocks(data.lower()):
        words = tail + words
        add([b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))])
        tail = words[1 - shingle :] if shingle > 1 else []
    if not total and tail:
        add([b" ".join(tail)])
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, f0: 64-bit fingerprint as a signed long; texts without words have zero."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column(1)):
                if t.is_valid:
                    out[i] = simhash(t.as_buffer().to_pybytes(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "f0"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, f0 long")


def _linked(a: np.ndarray, b: np.ndarray, shared: int = 8 - BITS, bits: int = BITS) -> np.ndarray:
    """Which pairs are links: first the tally of shared bytes, then, for those that reach the minimum, the differing bits."""
    x = a ^ b
    ok = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= shared
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def run_links(keys: np.ndarray, fps: np.ndarray, wide: int = 32, linked=_linked) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links inside each run of equal keys: all of a short run, of a long one those that span its components."""
    n = len(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[first, n])
    us, vs = [], []
    small = np.repeat(length <= wide, length)
    for step in range(1, int(min(wide, length.max(initial=1)))):
        i = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step])) if n > step else np.empty(0, int)
        if not len(i):
            break
        ok = i[linked(fps[i], fps[i + step])]
        us.append(ok)
        vs.append(ok + step)
    for start, size in zip(first[length > wide], length[length > wide]):
        f, label = fps[start : start + size], np.arange(size)
        for i in range(size):
            other = np.flatnonzero(label != label[i])
            if not len(other):
                break
            hit = other[linked(f[other], np.broadcast_to(f[i], len(other)))]
            if len(hit):
                _, one = np.unique(label[hit], return_index=True)
                us.append(np.full(len(one), start + i))
                vs.append(start + hit[one])
                label[np.isin(label, label[hit])] = label[i]
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def run_edges(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray):
    """Stars (node, smallest node of its component) of the links inside each run of equal keys."""
    return local_stars(nodes, *run_links(keys, fps))


def byte_index(classes: DataFrame, sets: tuple = QUADRUPLES) -> DataFrame:
    """key, node, f0: each fingerprint (f0, node) under its bytes at the positions of every listed set."""
    keys = []
    for number, positions in enumerate(sets):
        mask = sum(0xFF << (8 * p) for p in positions)
        keys.append(F.xxhash64(F.lit(number), F.col("f0").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "node", "f0")


def components(prints: DataFrame) -> DataFrame:
    """doc_id, f0, component_id for a table of fingerprints (read several times: materialise it first).

    component_id is the smallest doc_id reachable by links, null if no reachable row has an id.
    """
    classes = cut(prints.groupBy("f0").agg(F.min("doc_id").alias("node")))

    def edges(run: pa.Table):
        u, v = run_edges(run["key"].to_numpy(), run["node"].to_numpy(), run["f0"].to_numpy().view(np.uint64))
        return pa.table({"u": u, "v": v})

    roots = connected_components(arrow_map(byte_index(classes.where("node IS NOT NULL")), edges, "u long, v long", "key"))
    labelled = classes.join(roots, classes.node == roots.node, "left").select("f0", F.coalesce("root", classes.node).alias("component_id"))
    return prints.join(labelled, "f0").select("doc_id", "f0", "component_id")


def near_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that share NEAR_SHARED bytes and differ in NEAR_BITS bits at most, for a table of node, f0; nodes are distinct.

    The pairs span the components of all such pairs: of equal fingerprints, each node goes with the smallest, and each table
    of lists gives a forest.
    """
    classes = cut(prints.groupBy("f0").agg(F.min("node").alias("node")))

    def links(run: pa.Table):
        key, node, f0 = (run[c].to_numpy() for c in ("key", "node", "f0"))
        order = np.lexsort((node, key))  # lists of one group have the same middle, so that most of their links are the same pairs
        u, v = run_links(key[order], f0[order].view(np.uint64), linked=lambda a, b: _linked(a, b, NEAR_SHARED, NEAR_BITS))
        nodes, place = np.unique(node[order], return_inverse=True)
        u, v = place[u], place[v]
        kept = local_forest(len(nodes), u, v)
        return pa.table({"u": nodes[u[kept]], "v": nodes[v[kept]]})

    met = arrow_map(byte_index(classes, HALVES), links, "u long, v long", "key")
    same = prints.join(classes.withColumnRenamed("node", "least"), "f0").where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    pairs = cut(met.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    release(prints.sparkSession)
    return pairs


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and link like any other.  Rows without doc_id are never a
    component's id and link only through an equal fingerprint.  Empty tables give empty results; other columns are
    neither read nor returned.
    """
    found = components(cut(fingerprints(docs, text, doc_id, shingle)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """`docs` with the smallest doc_id of each group of near copies; rows without doc_id stay, as do blank texts'.

    Near copies are texts whose sets of shingles have a Jaccard similarity of 0.8 or more, computed exactly; groups are
    closed under such links.  The operator's steps come first: fingerprints, here of sets, lists by byte positions, the
    tally of shared bytes and the differing bits (near_pairs); whole sets then decide on these pairs.  Of the links at 0.8
    that is a part only: two 64-bit fingerprints are expected to differ in ten bits there, which guarantees no shared byte at
    all.  So shingle_join meets the rest exactly: every pair of texts that these steps left in different groups.
    """
    rows, roots = near_components(docs, text, doc_id, shingle)
    linked = rows.join(roots, "node", "left")
    # Equal sets are one node, with links or without.
    group = F.coalesce("root", "node")
    least = linked.groupBy(group.alias("root")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least != most")
    dropped = linked.withColumn("root", group).join(least, "root").where("doc_id != least").select("doc_id", "mark")
    return without(docs, dropped, doc_id, F.xxhash64(F.col(text)))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
