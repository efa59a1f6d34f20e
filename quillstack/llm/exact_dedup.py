"""Operator 2, exact dedup by a heavy-hitter split, in DataFrame functions only.

`DataFrame.stat.freqItems` is the Misra-Gries summary (in Karp, Schenker and Papadimitriou's form): it holds every
digest that takes more than `support` of the rows, and at most 1/support digests.  These candidates are counted
exactly, the true heavy hitters' winners are broadcast (at most 1/support rows, whatever the input) and resolved
map-side.  No remaining digest has more than `support` of the rows, so an ordinary shuffle of (doc_id, digest) has
no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, table, without

#: Share of the rows above which a digest is heavy; at most 1/SUPPORT winners are broadcast (about 200 kB).
SUPPORT = 1 / 2000


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  keep_id is the group's smallest doc_id; rows that repeat both doc_id and text are
    one document and share its decision.  A null doc_id is larger than any other: such a row stays only in a group
    without ids.  Empty tables give empty results; other columns are neither read nor returned.
    """
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256")))
    frequent = rows.stat.freqItems(["text_sha256"], support)
    candidates = frequent.select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    of_group = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = cut(rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*of_group).where("group_size > 1"))
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = rows.join(F.broadcast(winners), "text_sha256", "left_anti").select(
        "*", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` without the rows that exact_groups() drops; rows without a doc_id stay."""
    dropped = exact_groups(docs, text, doc_id).where("NOT kept AND doc_id IS NOT NULL").select("doc_id", F.col("text_sha256").alias("mark"))
    return without(docs, dropped, doc_id, F.sha2(normalised(F.col(text)), 256))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
