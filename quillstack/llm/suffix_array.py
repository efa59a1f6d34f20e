"""Operator 9, suffix-array dedup: removes every byte of a long string that has occurred before.

A text collection can't be suffix-sorted in one place, so candidates are found first.  Of the 24-byte substrings in each
100-byte window the one with the least hash is an anchor; equal windows have equal anchors, and about one position in
forty is one.  Anchors with their context (all bytes that share a window with them) are hashed:

1. map side, of equal contexts only the first is sent on, the others are known to be repeats;
2. grouped by anchor, later occurrences of an equal context are repeats in full, a lone context is unique, and only where
   an anchor has several contexts do the texts have to be compared;
3. for those, one context of each kind is cut from its document, and each anchor's contexts are sorted by a two-stage
   suffix array: only suffixes smaller than their successors are sorted directly, the rest is induced by bucket scans.
   Adjacent common prefixes of 100 bytes and more are repeats, the first by (doc_id, offset) stays.  An anchor
   with very many contexts is instead resolved by a hash per window, so no group has to fit into a task.

Results are exact up to collisions of hashes of 104 bits and more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, sorted_runs, stored, table

WIDTH = 100
GRAM = 24
#: Contexts of one anchor that are sorted together.
MAX_CONTEXTS = 2000
CHUNK_BYTES, COMBINE_ROWS, HALO = 1 << 19, 200_000, 512

_BYTES = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _K[1]
    x ^= x >> np.uint64(29)
    return x


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * _K[0] + right)


def _slide(x: np.ndarray, size: int, op, back: bool = False) -> np.ndarray:
    """op over [i, i + size) for each i, or over (i - size, i] if back; what would lie outside is left out."""
    done = 1
    while done < size:
        step = min(done, size - done)
        y = x.copy()
        if back:
            op(x[step:], x[:-step], out=y[step:])
        else:
            op(x[:-step], x[step:], out=y[:-step])
        x, done = y, done + step
    return x


def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH):
    """(segment, position in buffer, left, size, key, context) for the anchors of segments of a byte buffer.

    The context of an anchor is [position - left, position - left + size).
    """
    n, grams = len(buffer), width - GRAM + 1
    h = {1: _BYTES[buffer]}
    for size in (1, 2, 4, 8, 16, 32, 64):
        h[2 * size] = h[size].copy()
        if n > size:
            h[2 * size][:-size] = _join(h[size][:-size], h[size][size:])
        if size not in (16, 64):
            del h[size]
    key = h[16].copy()
    if n > 8:
        key[:-8] = _join(h[16][:-8], h[16][8:])  # 24 bytes as two halves that overlap
    least = _slide(key, grams, np.minimum)
    seg = np.repeat(np.arange(len(starts)), ends - starts)
    least[np.arange(n) + width > ends[seg]] = 0
    most = _slide(least, grams, np.maximum, back=True)
    p = np.flatnonzero((most == key) & (most > 0))
    s = seg[p]
    lo = np.maximum(starts[s], p - (width - GRAM))
    hi = np.minimum(ends[s], p + width)
    size = hi - lo
    short = size <= 128
    first = np.where(short, h[64][lo], h[128][np.minimum(lo, n - 1)])
    last = np.where(short, h[64][hi - 64], h[128][np.maximum(hi - 128, 0)])
    context = _mix(_join(first, last) + size.astype(np.uint64) * _K[2] + (p - lo).astype(np.uint64) * _K[3])
    return s, p, p - lo, size, key[p], context


def _segments(ids, texts):
    """(doc_id, offset, bytes, core start, core end): documents, very long ones in overlapping pieces."""
    for doc, t in zip(ids, texts):
        if doc is None or not t.is_valid:
            continue
        data = np.frombuffer(t.as_buffer(), np.uint8)
        for at in range(0, len(data), CHUNK_BYTES):
            lo, hi = max(0, at - HALO), min(len(data), at + CHUNK_BYTES + HALO)
            if hi - lo >= WIDTH:
                yield doc, lo, data[lo:hi], at - lo, min(len(data), at + CHUNK_BYTES) - lo


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals within each document, sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    change = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(change) - 1
    shift = group * (int(end.max()) + 1)  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(end + shift)
    new = change.copy()
    new[1:] |= start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - shift)[np.r_[at[1:], len(doc)] - 1]


ROW = "key long, context long, doc long, place long"


def _rows(key, context, doc, place):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (key, context, doc, place)], ["key", "context", "doc", "place"])


def _combined(key, context, doc, place):
    """First occurrence of each (key, context); intervals (place < 0: ~start, context: end) of the others."""
    order = np.lexsort((place, doc, context, key))
    key, context, doc, place = key[order], context[order], doc[order], place[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (doc != doc[head]) | (place != place[head])
    d, s, e = merge(*_interval(doc[later], place[later]))
    yield _rows(key[new], context[new], doc[new], place[new])
    if len(d):
        yield _rows((d * 7919) & 0xFFFFFFFFFF, e, d, ~s)


def _interval(doc, place):
    """The context's bytes; place holds position, left and size."""
    start = (place >> 16) - ((place >> 8) & 0xFF)
    return doc, start, start + (place & 0xFF)


def _scan(batches):
    held: list[tuple] = []
    count = 0

    def flush(segments):
        nonlocal count
        sizes = np.array([len(x[2]) for x in segments])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        s, p, left, size, key, context = anchors(np.concatenate([x[2] for x in segments]), starts, ends)
        docs, offsets, lows, highs = (np.array([x[i] for x in segments], np.int64) for i in (0, 1, 3, 4))
        local = p - starts[s]
        core = (local >= lows[s]) & (local < highs[s])
        place = ((local + offsets[s]) << 16) | (left << 8) | size
        held.append(((key >> np.uint64(24)).astype(np.int64)[core], context.view(np.int64)[core], docs[s][core], place[core]))
        count += int(core.sum())

    segments, n = [], 0
    for batch in batches:
        for segment in _segments(batch.column("doc").to_pylist(), batch.column("text")):
            segments.append(segment)
            n += len(segment[2])
            if n >= CHUNK_BYTES:
                flush(segments)
                segments, n = [], 0
                if count >= COMBINE_ROWS:
                    yield from _combined(*(np.concatenate(x) for x in zip(*held)))
                    held, count = [], 0
        segments = [(*x[:2], x[2].copy(), *x[3:]) for x in segments]  # the batch's memory goes
    if segments:
        flush(segments)
    if held:
        yield from _combined(*(np.concatenate(x) for x in zip(*held)))


FOUND = "doc long, start long, stop long, key long"


def _found(doc, start, stop, key):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, start, stop, key)], ["doc", "start", "stop", "key"])


def _resolve(batches):
    """From rows sorted by (key, context, doc, place): intervals (key null as -1) and contexts to compare.

    Of a run of equal (key, context) the first row is held until it is known whether the key has another context.
    """
    pending = None  # key, context, doc, place of the last run's first row; has its key been seen before it
    for batch in batches:
        key, context, doc, place = (batch.column(c).to_numpy() for c in ("key", "context", "doc", "place"))
        ready = place < 0
        if ready.any():
            yield _found(doc[ready], ~place[ready], context[ready], np.full(ready.sum(), -1))
            key, context, doc, place = key[~ready], context[~ready], doc[~ready], place[~ready]
        if not len(key):
            continue
        if pending:
            key, context, doc, place = (np.r_[x, y] for x, y in zip(([pending[0]], [pending[1]], [pending[2]], [pending[3]]), (key, context, doc, place)))
        new = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = (doc != doc[head]) | (place != place[head])
        if later.any():
            d, s, e = merge(*_interval(doc[later], place[later]))
            yield _found(d, s, e, np.full(len(d), -1))
        runs = np.flatnonzero(new)
        k = key[runs]
        before = np.r_[bool(pending and pending[4]), k[1:] == k[:-1]]
        mixed = runs[:-1][before[:-1] | (k[:-1] == k[1:])]
        if len(mixed):
            yield _found(doc[mixed], place[mixed], place[mixed], key[mixed])
        last = runs[-1]
        pending = (key[last], context[last], doc[last], place[last], before[-1])
    if pending and pending[4]:
        yield _found([pending[2]], [pending[3]], [pending[3]], [pending[0]])


def two_stage(text: np.ndarray, depth: int = WIDTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of bytes, ordered by the first `depth` bytes at least; of the `wanted` suffixes (a mask), if given.

    Stage one sorts the suffixes that are smaller than their successors.  Stage two scans the buckets of first bytes
    from the smallest: each suffix met there puts its predecessor, if that is larger than it, next in its own bucket.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    rise = np.sign(np.diff(text.astype(np.int16)))
    turns = np.flatnonzero(rise)
    at = np.searchsorted(turns, np.arange(n))
    smaller = np.zeros(n, bool)
    inside = at < len(turns)
    smaller[inside] = rise[turns[at[inside]]] > 0
    used = np.ones(n, bool)
    if wanted is not None:  # and those that these are induced from: the run after each up to one that is sorted directly
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(wanted, at, -1))
        stop = np.r_[-1, np.maximum.accumulate(np.where(smaller, at, -1))[:-1]]
        used = last > stop
        used[-1] = True
    data = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(smaller & used).tolist(), key=lambda i: data[i : i + depth]), np.int64)
    bounds = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, int)
    induce = used & ~smaller
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []

    def predecessors(suffixes: np.ndarray, c: int) -> np.ndarray:
        before = suffixes[suffixes > 0] - 1
        before = before[induce[before]]
        first = text[before]
        same = before[first == c]
        before, first = before[first != c], first[first != c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        for a, b in zip(cuts, [*cuts[1:], len(first)]):
            induced[first[a]].append(before[a:b])
        return same

    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = predecessors(wave, c)
        tail = direct[bounds[c] : bounds[c + 1]]
        if len(tail):
            out.append(tail)
            predecessors(tail, c)
    order = np.concatenate(out)
    return order if wanted is None else order[wanted[order]]


def repeated_windows(contexts: list[bytes], docs: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(doc, start, stop) of the windows in these contexts that also occur in them at an earlier (doc, offset)."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    local = np.arange(len(text)) - (ends - sizes)[owner]
    suffixes = two_stage(text, width, local + width <= sizes[owner] - 1)
    if len(suffixes) < 2:
        return (np.empty(0, np.int64),) * 3
    common = np.empty(len(suffixes), np.int64)  # length of the prefix shared with the suffix before, up to width
    common[0] = 0
    windows = np.lib.stride_tricks.sliding_window_view(text, width)
    for a in range(1, len(suffixes), 1 << 13):
        b = min(len(suffixes), a + (1 << 13))
        rows = windows[suffixes[a - 1 : b]]
        differ = rows[1:] != rows[:-1]
        common[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    starts = np.flatnonzero(common < width)
    doc, start = docs[owner[suffixes]], offsets[owner[suffixes]] + local[suffixes]
    order = np.lexsort((start, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[0, (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])])
    first = np.minimum.reduceat(rank, starts)
    later = rank > np.repeat(first, np.diff(np.r_[starts, len(rank)]))
    return merge(doc[later], start[later], start[later] + width)


PIECE = "key long, kind int, payload binary, doc long, start long"


def _pieces(batches):
    """Contexts (kind 0) of the documents' marked anchors, or (kind 1) a hash per window where an anchor is crowded.

    Of equal windows in a batch of documents the first is sent on, the others are returned as intervals (kind 2).
    """
    names = ["key", "kind", "payload", "doc", "start"]
    for batch in batches:
        rows = []
        windows: dict[bytes, tuple] = {}
        repeats = []
        for doc, t, marks in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
            data = t.as_buffer().to_pybytes()
            for mark in marks:
                lo = (mark["place"] >> 16) - ((mark["place"] >> 8) & 0xFF)
                hi = lo + (mark["place"] & 0xFF)
                if not mark["crowded"]:
                    rows.append((mark["key"], 0, data[lo:hi], doc, lo))
                    continue
                for s in range(lo, hi - WIDTH + 1):
                    digest = xxhash.xxh3_128_digest(data[s : s + WIDTH])
                    seen = windows.setdefault(digest, (doc, s))
                    if seen != (doc, s):
                        windows[digest] = min(seen, (doc, s))
                        repeats.append(max(seen, (doc, s)))
        rows += [(int.from_bytes(h[:8], "little", signed=True), 1, h[8:], d, s) for h, (d, s) in windows.items()]
        if repeats:
            d, s = (np.array(x, np.int64) for x in zip(*repeats))
            rows += [((x * 7919) & 0xFFFFFFFFFF, 2, int(z).to_bytes(8, "little"), x, y) for x, y, z in zip(*(v.tolist() for v in merge(d, s, s + WIDTH)))]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _compare(batches):
    """Intervals from whole runs of keys of _pieces() rows."""
    for run in sorted_runs(batches, "key", 6000):
        kind, doc, start = (run[c].to_numpy() for c in ("kind", "doc", "start"))
        payload = run["payload"].to_pylist()
        context = np.flatnonzero(kind == 0)
        if len(context):
            key = run["key"].to_numpy()[context]
            cuts = [0]
            for i in np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1:  # whole keys, some thousand contexts at a time
                if i - cuts[-1] >= 4000 or i == len(key):
                    cuts.append(int(i))
            for a, b in zip(cuts, cuts[1:]):
                own = context[a:b]
                d, s, e = repeated_windows([payload[i] for i in own], doc[own], start[own])
                if len(d):
                    yield _found(d, s, e, np.full(len(d), -1))
        first: dict[tuple, tuple] = {}
        window = np.flatnonzero(kind == 1).tolist()
        names = run["key"].to_pylist() if window else []
        for i in window:
            h, at = (names[i], payload[i]), (doc[i], start[i])
            first[h] = min(first.get(h, at), at)
        later = [i for i in window if first[names[i], payload[i]] < (doc[i], start[i])]
        if later:
            d, s, e = merge(doc[later], start[later], start[later] + WIDTH)
            yield _found(d, s, e, np.full(len(d), -1))
        ready = np.flatnonzero(kind == 2)
        if len(ready):
            yield _found(doc[ready], start[ready], [int.from_bytes(payload[i], "little") for i in ready], np.full(len(ready), -1))


def _cut_out(batches):
    for batch in batches:
        out = []
        for doc, t, spans in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans")):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            kept, at, removed, n = [], 0, 0, 0
            if spans.is_valid:
                s, e = (spans.values.field(k).to_numpy() for k in (0, 1))
                _, s, e = merge(np.zeros(len(s), np.int64), s, e)
                for a, b in zip(s.tolist(), e.tolist()):
                    kept.append(data[at:a])
                    at = b
                removed, n = int((e - s).sum()), len(s)
            kept.append(data[at:])
            digest = hashlib.sha256()
            for x in kept:
                digest.update(x)
            out.append((doc, len(data), removed, n, digest.hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, spans (array of start, stop in bytes; may overlap) for each document with bytes to remove."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    sent = source.mapInArrow(_scan, ROW).repartition("key").sortWithinPartitions("key", "context", "doc", "place")
    found = stored(sent.mapInArrow(_resolve, FOUND))
    del sent
    release(docs.sparkSession)
    mixed = found.where("key >= 0").select("doc", "key", F.col("start").alias("place"))
    # Materialised, so that the join below is a stage of its own, whose hot keys adaptive execution can split.
    crowded = cut(mixed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CONTEXTS).select("key", F.lit(True).alias("crowded")))
    marks = mixed.join(crowded, "key", "left").groupBy("doc").agg(F.collect_set(F.struct("place", "key", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("marks"))
    pieces = source.join(marks, "doc").mapInArrow(_pieces, PIECE)
    compared = stored(pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, FOUND))
    del pieces
    release(docs.sparkSession)
    spans = found.where("key < 0").unionByName(compared)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeated_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty.  Rows without doc_id have no order: they come back whole and cause no removal.  Rows that
    repeat a doc_id with its text are one document.  Texts of any length are handled whole; empty tables give empty
    results; other columns are neither read nor returned.
    """
    spans = repeated_spans(docs, text, doc_id)
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    joined = source.join(spans, "doc", "left").select("doc", "text", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents"))
