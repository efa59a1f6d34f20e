"""Operator 4, variable-capacity best-fit packing into several permitted sequence lengths.

Documents longer than the longest length are cut into pieces.  Pieces are dealt by hash into shards of about
SHARD_PIECES; each shard is packed by best-fit decreasing: a piece goes to the open bin that it leaves fullest; if none
has room, the bin size with the least cost per token that can still be filled is opened; at the end each bin is cut
down to the smallest permitted length that holds its contents.  A shard has hundreds of bins; what packing shards
apart wastes is tested against one shard for all.  Pieces carry their range of the text, so that sequences can be cut
out without counting again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, table
from .mixing import words

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of n tokens, in tokens: n, a fixed part, and n * n / ATTENTION for attention.
OVERHEAD, ATTENTION = 64, 1 << 16
SHARD_PIECES = 8192
#: Copies of one row that a task makes at once.
PORTION = 4096


def cost(length: int) -> float:
    return length + OVERHEAD + length * length / ATTENTION


def pack(sizes, lengths=LENGTHS, cost=cost):
    """(bin, offset, capacities): each piece's bin and first position in it, and each bin's final length."""
    lengths = sorted(lengths)
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    bin_of, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    used: list[int] = []
    by_room: dict[int, list[tuple[int, int]]] = {}  # room left -> open bins with their opened length
    rooms = 0  # bit r is set if a bin with room r is open
    left = int(sum(sizes))
    for i in order.tolist():
        n = int(sizes[i])
        left -= n
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b, length = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            length = min((x for x in lengths if x >= n), key=lambda x: (cost(x) / min(x, n + left), x))
            b = len(used)
            used.append(0)
            room = length
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if room := room - n:
            by_room.setdefault(room, []).append((b, length))
            rooms |= 1 << room
    return bin_of, offset, np.array([next(x for x in lengths if x >= u) for u in used], np.int64)


def _piece_lengths(text, size, longest: int):
    """Code points of each piece; pieces make up the whole text, and a break comes right after the last word before it."""
    piece = rf"(?:{SPACE[:-1]}*+{WORD}+){{1,{longest}}}+"
    lengths = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), lambda x: F.length(x).cast("long"))
    return F.when(size > longest, lengths).otherwise(F.array(F.coalesce(F.length(text), F.lit(0)).cast("long")))


def pack_documents(docs: DataFrame, text="text", doc_id="doc_id", lengths=LENGTHS, cost=cost, shard_pieces=SHARD_PIECES, with_text=False) -> DataFrame:
    """One row per piece: doc_id, piece, start (in words), n_tokens, char_start, char_end (code points), bin_id, capacity, position; text, if asked for.

    Tokens are words.  The pieces' ranges make up a document's whole text.  A row without words has one piece of no
    tokens and no bin.  Equal rows (a mix repeats documents) are packed each on its own; they, and rows without doc_id,
    spread over all shards.  Empty tables give empty results; other columns are neither read nor returned.
    """
    longest = max(lengths)
    mark = F.xxhash64(F.col(text)).alias("mark")
    size = words(F.col(text))
    sized = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark, size.alias("size"), _piece_lengths(F.col(text), size, longest).alias("chars"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")))
    # Equal rows are counted, and numbered in portions, so that no task makes all copies of a row.
    same = sized.groupBy("doc_id", "mark", "size", "chars", "n_chars").agg(F.count("*").alias("n"))
    same = same.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PORTION).cast("long"))))
    same = same.repartition("doc_id", "mark", "portion")
    rows = same.withColumn("copy", F.explode(F.sequence("portion", F.least(F.col("portion") + PORTION, F.col("n")) - 1)))
    rows = rows.select("doc_id", "mark", "copy", "size", "chars", "n_chars", F.posexplode("chars").alias("piece", "long"))
    start = F.col("piece").cast("long") * longest
    at = F.aggregate(F.slice("chars", 1, F.col("piece")), F.lit(0).cast("long"), lambda x, y: x + y)
    last = F.col("piece") == F.size("chars") - 1
    pieces = cut(
        rows.select(
            "doc_id", "mark", "copy", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).cast("long").alias("n_tokens"),
            at.alias("char_start"), F.when(last, F.col("n_chars")).otherwise(at + F.col("long")).cast("long").alias("char_end"),
        )
    )
    shards = max(1, math.ceil(pieces.count() / shard_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "mark", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets, capacity = pack(group["n_tokens"].to_numpy(), lengths, cost)
        return group.assign(bin_id=(group["shard"].to_numpy().astype(np.int64) << 32) + bins, capacity=capacity[bins], position=offsets).drop(columns="shard")

    shard = F.pmod(F.xxhash64("doc_id", "mark", "piece", "copy"), F.lit(shards)).cast("int")
    schema = "doc_id long, mark long, copy long, piece int, start long, n_tokens long, char_start long, char_end long, bin_id long, capacity long, position long"
    packed = pieces.where("n_tokens > 0").withColumn("shard", shard).groupBy("shard").applyInPandas(run, schema)
    none = pieces.where("n_tokens = 0").select("*", *(F.lit(None).cast("long").alias(c) for c in ("bin_id", "capacity", "position")))
    placed = packed.unionByName(none)
    result = ["doc_id", "piece", "start", "n_tokens", "char_start", "char_end", "bin_id", "capacity", "position"]
    if not with_text:
        return placed.select(result)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark, F.col(text).alias("text")).select(own.alias("own"), "mark", "text").dropDuplicates(["own", "mark"])
    part = F.coalesce(F.substring("text", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int")), F.lit(""))
    return placed.withColumn("own", own).join(texts, ["own", "mark"]).select(*result, part.alias("text"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
