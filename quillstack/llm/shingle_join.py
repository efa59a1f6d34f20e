"""Links of texts whose sets of word shingles have a Jaccard similarity of 4/5 or more: SimHash, prefix filter, verification.

Pairs that simhash.near_pairs() finds by fingerprints are verified and linked first; all that follows compares only sets of
different components.

Shingles are put in one order over all documents, rare ones first.  Two sets of similarity t share one of the first
n - ceil(t n) + 1 shingles of each, so an index of these prefixes holds every such pair (length and position bounds drop
only pairs that can't reach t).  Candidates are screened by the tally of their common prefix, and the similarity of what is
left is computed from both whole sets.  Long lists first give a few pairs a row; after these links, only pairs of
different components are left to compare, and all of them are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, cut, discard, release, stored

#: Similarity PART / WHOLE in integers, so that a pair at exactly 0.8 counts.
PART, WHOLE = 4, 5
#: The order needs frequencies only roughly: of buckets of shingles, the most frequent of each task.
BUCKET_BITS, TASK_BUCKETS, ALL_BUCKETS = 20, 4096, 65536
#: Lists up to WIDE rows give all their pairs at once; longer ones CHAIN pairs a row first, in one of ORDERS orders.
WIDE, CHAIN, ORDERS = 16, 3, 3


def _pieces(batch_rows, schema: pa.Schema, size: int = 1 << 25):
    """Record batches of about `size` bytes in the last (binary) column."""
    rows, held = [], 0
    for row in batch_rows:
        rows.append(row)
        held += len(row[-1])
        if held > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 values (seed 42) of the shingles; a shorter text is one shingle, a blank one has none."""
    from .simhash import word_blocks

    found, tail = [], []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks(data.lower()):
        words = tail + words
        found += [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))]
        tail = words[1 - shingle :] if shingle > 1 else []
    if not found and tail:
        found = [digest(b" ".join(tail), 42)]
    return np.unique(np.array(found, np.uint64))


def shingle_source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, mark (of the text), text of each row that has a doc_id and a text; other columns are left out."""
    whole = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return whole.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("binary").alias("text"))


def frequent_buckets(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, about how many shingles) of the most frequent buckets; any result gives a valid order."""
    buckets = 1 << BUCKET_BITS

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(counts, (shingle_set(t.as_buffer().to_pybytes(), shingle) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        top = np.argpartition(counts, -TASK_BUCKETS)[-TASK_BUCKETS:]
        top = top[counts[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(counts[top])], ["bucket", "n"])

    sums = source.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = sums.orderBy(F.desc("n"), "bucket").limit(ALL_BUCKETS).toArrow()
    return out["bucket"].to_numpy(), out["n"].to_numpy()


def prefixes(source: DataFrame, shingle: int, bucket: np.ndarray, often: np.ndarray) -> DataFrame:
    """doc_id, mark, node (hash of the set), n, f0 (its fingerprint), prefix (its rarest shingles, rare ones first) of each row with words.

    Whole sets are some eight bytes a word, more than the text, so they are never stored: verification makes those it
    needs anew.
    """
    from .simhash import set_fingerprint

    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "mark", "node", "n", "f0")), ("prefix", pa.binary())])

    def run(batches):
        weight = np.zeros(1 << BUCKET_BITS, np.int64)
        weight[bucket] = often

        def rows(batch):
            for i, mark, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(t.as_buffer().to_pybytes(), shingle)
                if n := len(s):
                    node = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))
                    order = np.lexsort((s, weight[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
                    yield i, mark, node, n, set_fingerprint(s), s[order[: n - -(-PART * n // WHOLE) + 1]].tobytes()

        for batch in batches:
            yield from _pieces(rows(batch), schema)

    return source.mapInArrow(run, "doc_id long, mark long, node long, n long, f0 long, prefix binary")


def prefix_index(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """token, node, place (n and, in the low half, position in the prefix), root (null without links): the prefix of each distinct set."""

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column(2).to_pylist()
                sizes = np.array([len(x) // 8 for x in lists], np.int64)
                tokens = np.frombuffer(b"".join(lists), np.int64)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                node, n = (np.repeat(part.column(k).to_numpy(), sizes) for k in (0, 1))
                root = part.column(3).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(node), pa.array((n << 32) | pos), root], ["token", "node", "place", "root"])

    distinct = rows.select("node", "n", "prefix").dropDuplicates(["node"]).join(roots, "node", "left")
    return distinct.select("node", "n", "prefix", "root").mapInArrow(explode, "token long, node long, place long, root long")


def listed_pairs(run: pa.Table) -> pa.Table:
    """first_pairs() of index rows."""
    place = run["place"].to_numpy()
    root = pc.coalesce(run["root"], run["node"])
    run = pa.table({"token": run["token"], "node": run["node"], "n": (place >> 32).astype(np.int32), "pos": (place & 0x7FFFFFFF).astype(np.int32), "root": root})
    return first_pairs(run)


def _possible(n, pos, i, j) -> np.ndarray:
    """Whether the rows' sets, if these are their first common shingle, can reach the similarity."""
    a, b = n[i].astype(np.int64), n[j].astype(np.int64)
    return (PART + WHOLE) * np.minimum(a - pos[i], b - pos[j]) >= PART * (a + b)


def _pairs(node, us, vs) -> tuple[np.ndarray, np.ndarray]:
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = node[np.concatenate(us)], node[np.concatenate(vs)]
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return both[0], both[1]


def first_pairs(run: pa.Table) -> pa.Table:
    """Pairs (u, v) of the lists in `run`; the rows of long lists come along with a null v, for other_pairs().

    With a column root, only pairs of different roots.
    """
    token, node, n, pos, root = (run[c].to_numpy() for c in ("token", "node", "n", "pos", "root" if "root" in run.column_names else "node"))
    # Long lists of one group share a few orders, so that most of their chains are the same pairs, which then count once.
    order = np.lexsort(((node ^ (token % ORDERS) * np.int64(0x2545F4914F6CDD1D)) * np.int64(0x1E3779B97F4A7C15), token))
    token, node, n, pos, root = token[order], node[order], n[order], pos[order], root[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[first, len(token)])
    size = np.repeat(length, length)
    us, vs = [], []
    # The member with the fewest rare shingles is nearest to what a group's texts have in common.
    tidy = np.lexsort((node, pos, token))[first] if len(token) else first
    i = np.flatnonzero(size > WIDE)
    j = np.repeat(tidy, length)[i]
    ok = (root[i] != root[j]) & _possible(n, pos, i, j)
    us.append(i[ok])
    vs.append(j[ok])
    for step in range(1, min(WIDE, int(length.max(initial=1)))):
        i = np.flatnonzero((token[step:] == token[:-step]) & ((size[:-step] <= WIDE) | (step <= CHAIN)))
        i = i[(root[i] != root[i + step]) & _possible(n, pos, i, i + step)]
        us.append(i)
        vs.append(i + step)
    u, v = _pairs(node, us, vs)
    long_ = size > WIDE
    none = lambda kind: pa.nulls(len(u), kind)
    pairs = pa.table({"u": u, "v": v, "token": none(pa.int64()), "n": none(pa.int32()), "pos": none(pa.int32())})
    lists = pa.table({"u": node[long_], "v": pa.nulls(int(long_.sum()), pa.int64()), "token": token[long_], "n": n[long_], "pos": pos[long_]})
    return pa.concat_tables([pairs, lists]).combine_chunks()


def partnered(run: pa.Table) -> pa.Table:
    """The rows that some row of another root in their list could reach the similarity with, by size and position."""
    token, n, pos, root = (run[c].to_numpy() for c in ("token", "n", "pos", "root"))
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    kept = np.zeros(len(token), bool)
    for start, end in zip(first, np.r_[first[1:], len(token)]):
        own = np.arange(start, end)
        for i in own[:-1]:
            rest = own[i - start + 1 :]
            j = rest[(root[rest] != root[i]) & _possible(n, pos, np.full(len(rest), i), rest)]
            kept[j] = True
            kept[i] |= len(j) > 0
    return run.filter(pa.array(kept))


def other_pairs(run: pa.Table, weight: np.ndarray | None = None) -> pa.Table:
    """All pairs of different roots in each list; small components come first, so that a large one is never met with itself.

    With prefixes and the order's weights, a pair comes from the list of its first common shingle only, and only if it
    can_reach() the similarity.
    """
    token, node, n, pos, root = (run[c].to_numpy() for c in ("token", "u", "n", "pos", "root"))
    prefix = None if weight is None else [np.frombuffer(x.as_buffer(), np.uint64) for x in run["prefix"]]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    us, vs, out = [], [], []
    for start, end in zip(first, np.r_[first[1:], len(token)]):
        _, label, count = np.unique(root[start:end], return_inverse=True, return_counts=True)
        if len(count) == 1:
            continue
        order = start + np.lexsort((label, count[label]))
        ends = np.searchsorted(np.arange(len(order)), np.flatnonzero(np.r_[label[order - start][1:] != label[order - start][:-1], True]) + 1)
        before = prefix and {i: frozenset(prefix[i][: pos[i]].tolist()) for i in order.tolist()}
        at = 0
        for stop in ends[:-1]:
            rest = order[stop:]
            for i in order[at:stop]:
                j = rest[_possible(n, pos, np.full(len(rest), i), rest)]
                if prefix:
                    j = np.array([k for k in j.tolist() if before[i].isdisjoint(before[k]) and can_reach(prefix[i], n[i], prefix[k], n[k], weight)], np.int64)
                us.append(np.full(len(j), i))
                vs.append(j)
            at = stop
        if sum(map(len, us)) > 2_000_000:
            out.append(_pairs(node, us, vs))
            us, vs = [], []
    out.append(_pairs(node, us, vs))
    return pa.table({"u": np.concatenate([x for x, _ in out]), "v": np.concatenate([x for _, x in out])})


def can_reach(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, weight: np.ndarray) -> bool:
    """Whether sets of n_a and n_b shingles with these prefixes can have the similarity.

    Up to the earlier of the prefixes' ends, all shingles of both sets are known: their tally, and at most all that
    comes later, must reach the overlap that the similarity takes.
    """
    rank_a, rank_b = (weight[(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] for x in (a, b))
    end = min((rank_a[-1], a[-1]), (rank_b[-1], b[-1]))
    seen_a, seen_b = (x[(rank < end[0]) | ((rank == end[0]) & (x <= end[1]))] for x, rank in ((a, rank_a), (b, rank_b)))
    both = np.concatenate([seen_a, seen_b])
    both.sort()
    most = int((both[1:] == both[:-1]).sum()) + min(n_a - len(seen_a), n_b - len(seen_b))
    return (PART + WHOLE) * most >= PART * (n_a + n_b)


def screened(pairs: DataFrame, rows: DataFrame, bucket: np.ndarray, often: np.ndarray) -> DataFrame:
    """The pairs that can_reach() the similarity by their prefixes; a passage that two longer texts share is no near copy."""

    def run(batches):
        weight = np.zeros(1 << BUCKET_BITS, np.int64)
        weight[bucket] = often
        for batch in batches:
            keep = []
            for n_a, a, n_b, b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5)):
                keep.append(can_reach(np.frombuffer(a.as_buffer(), np.uint64), n_a, np.frombuffer(b.as_buffer(), np.uint64), n_b, weight))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = rows.select("node", "n", "prefix").dropDuplicates(["node"])
    met = pairs.join(own.select(F.col("node").alias("u"), F.col("n").alias("n_a"), F.col("prefix").alias("a")), "u")
    met = met.join(own.select(F.col("node").alias("v"), F.col("n").alias("n_b"), F.col("prefix").alias("b")), "v")
    left = cut(met.select("u", "v", "n_a", "a", "n_b", "b").mapInArrow(run, "u long, v long"))
    release(rows.sparkSession)
    return left


def verified(pairs: DataFrame, rows: DataFrame, source: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose sets have the similarity, from the whole sets; only texts of candidates are read into sets."""

    def sets(batches):
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
        for batch in batches:
            yield from _pieces(((node, shingle_set(t.as_buffer().to_pybytes(), shingle).tobytes()) for node, t in zip(batch.column(0).to_pylist(), batch.column(1))), schema)

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = np.concatenate([a, b])
                shared.sort()
                both = int((shared[1:] == shared[:-1]).sum())
                keep.append((PART + WHOLE) * both >= PART * (len(a) + len(b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    first = rows.select("node", "doc_id", "mark").join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    wanted = cut(first.select("node", "first.doc_id", "first.mark"))
    own = stored(source.join(wanted, ["doc_id", "mark"]).select("node", "text").mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]))
    release(source.sparkSession)
    met = pairs.join(own.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    met = met.join(own.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    links = cut(met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))
    discard(own)
    release(source.sparkSession)
    return links


def near_components(docs: DataFrame, text: str, doc_id: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark, node of each row with words; and node, root: the components of the sets that have links."""
    from .simhash import near_pairs

    source = shingle_source(docs, text, doc_id)
    order = frequent_buckets(source, shingle)
    rows = stored(prefixes(source, shingle, *order))
    near = connected_components(verified(near_pairs(rows.select("node", "f0").distinct()), rows, source, shingle))
    found = cut(arrow_map(prefix_index(rows, near), listed_pairs, "u long, v long, token long, n int, pos int", "token"))
    pairs = cut(found.where("v IS NOT NULL").select("u", "v").distinct())
    release(docs.sparkSession)
    links = verified(screened(pairs, rows, *order), rows, source, shingle).unionByName(near.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = connected_components(links)
    known, lists = rows.select("doc_id", "mark", "node"), found.where("v IS NULL")
    if lists.isEmpty():
        return known, roots
    lists = cut(lists.join(roots, lists.u == roots.node, "left").select("token", "u", "n", "pos", F.coalesce("root", "u").alias("root")))
    mixed = lists.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    open_ = arrow_map(lists.join(mixed, "token").select("token", "u", "n", "pos", "root"), partnered, "token long, u long, n int, pos int, root long", "token")
    lists = cut(open_)
    own = rows.select(F.col("node").alias("u"), "prefix").join(lists.select("u").distinct(), "u", "left_semi").dropDuplicates(["u"])
    lists = lists.join(own, "u").select("token", "u", "n", "pos", "root", "prefix")

    def left(run: pa.Table) -> pa.Table:
        weight = np.zeros(1 << BUCKET_BITS, np.int64)
        weight[order[0]] = order[1]
        return other_pairs(run, weight)

    others = cut(arrow_map(lists, left, "u long, v long", "token", 20_000).join(pairs, ["u", "v"], "left_anti"))
    release(docs.sparkSession)
    if others.isEmpty():
        return known, roots
    more = verified(others, rows, source, shingle)
    return known, roots if more.isEmpty() else connected_components(links.unionByName(more))
