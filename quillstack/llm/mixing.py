"""Operator 8, mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each document of a source is expected c = target / source size times.  With the documents of a source in a fixed
order, the prefix sum after the i-th is i * c; the document is emitted once per integer boundary that
prefix + offset crosses, with one random (hashed) offset per source.  The order goes by size class, so the words
taken come near the target although sizes differ a thousandfold.

Positions need no global sort: counts per (source, size class) and per (source, size class, slice) give the
prefixes, a row number inside a slice the rest.  Slices come from a hash of doc_id, so neither a hot source nor a
large group of copies meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(skey, source_size) -> also target: water-filling with a cap of `cap` times the source's size.

    With sources in the order of cap / weight, a source is capped if the level that the sources before it leave
    reaches its cap; the rest share what the capped ones leave, by weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("skey")
    before = Window.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sizes.select("*", w.cast("long").alias("w"), (F.col("source_size") * cap).alias("cap"))
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    capped = (F.col("budget") - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("capped", capped)
    taken = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    used = F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything)
    level = (F.col("budget") - taken) / F.nullif(F.col("all_w") - used, F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return s.select("skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, text="text", doc_id="doc_id", source="source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    Null texts have size 0; null is a source of its own, after all others.  A source without words has target 0.
    Equal rows are interchangeable: together they get their due copies.  Empty tables give empty results; other
    columns are neither read nor returned.
    """
    skey = F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("z"))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), skey.alias("skey"), words(F.col(text)).alias("size")))  # texts are read once
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    octave = F.length(F.bin("size"))
    rows = rows.select("*", (octave * 32 + F.expr("(size * 16) div shiftleft(1L, length(bin(size)) - 1)")).cast("int").alias("class"))
    rows = rows.withColumn("slice", F.substring("h", 1, 2))
    slices = rows.groupBy("skey", "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    classes = slices.groupBy("skey", "class").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    targets = source_targets(classes.groupBy("skey").agg(F.sum("s").alias("source_size")), weights, share, cap)
    earlier = (Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("class").rowsBetween(*earlier)), F.lit(0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("skey")).cast("binary")), 1, 5), 16, 10).cast("double") / (1 << 20)
    classes = classes.select("skey", "class", first.alias("class_first")).join(targets, "skey").withColumn("u", offset)
    within = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "class").orderBy("slice").rowsBetween(*earlier)), F.lit(0))
    slices = slices.select("skey", "class", "slice", within.alias("slice_first")).join(classes, ["skey", "class"])
    own = F.row_number().over(Window.partitionBy("skey", "class", "slice").orderBy("h", "doc_id"))
    placed = rows.withColumn("own", own).join(slices, ["skey", "class", "slice"])
    rank = F.col("class_first") + F.col("slice_first") + F.col("own")
    c = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    crossed = F.floor(rank * c + F.col("u")) - F.floor((rank - 1) * c + F.col("u"))
    copies = F.least(F.lit(cap), crossed).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed rows themselves: each row of `docs` as many times as mix() says."""
    own, times, copy = (fresh(docs, name) for name in ("own_id", "copies", "copy"))
    chosen = mix(docs, doc_id=doc_id, **options).where("copies > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times))
    joined = docs.join(chosen, F.col(doc_id).eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
r AS (SELECT doc_id, coalesce('a' || source, 'z') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '')) AS h FROM {docs}),
k AS (SELECT *, length(bin(size)) * 32 + (size * 16) // (1::BIGINT << (length(bin(size)) - 1)::BIGINT) AS class FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, h, doc_id NULLS FIRST) AS rank FROM k),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM r GROUP BY skey),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS w, source_size * 2 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w,
              coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
       FROM s1 WINDOW b AS (ORDER BY cap::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (budget - cap_before) * w >= cap * (all_w - w_before) AS capped FROM s2),
s4 AS (SELECT *, (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / nullif(all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER (), 0) AS level FROM s3),
s5 AS (SELECT skey, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level * w END AS target,
              ('0x' || substr(md5('mix-1' || skey), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM s4),
m AS (SELECT doc_id, size, source_size, target, u, rank, coalesce(target / nullif(source_size, 0), 0) AS c FROM p JOIN s5 USING (skey)),
mixed AS (SELECT doc_id, size, source_size, target, least(2, floor(rank * c + u) - floor((rank - 1) * c + u))::BIGINT AS copies FROM m)
"""
OP8_SQL = "WITH " + MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed"
