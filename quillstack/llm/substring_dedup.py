"""Operator 1, substring dedup by line or paragraph hashing.

Lines are wrapped at sentence ends before hashing, so that a passage inside a longer line is met, too.  Units are
normalised and hashed, digests are grouped globally (pre-aggregated, so a unit that a third of all documents holds
costs a row per task), the earliest occurrence by (doc_id, offset) stays and the later ones are repeats.  Removed are
runs of adjacent repeats with enough words: a single short sentence may well recur by chance.  Offsets are code points
of the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, table

#: What ends a unit; the text between two ends, with the second, is the unit.
ENDS = {"line": re.compile(r"[.!?…][\"'”’)\]]*[\x20\x09]+|[。！？]|\n"), "paragraph": re.compile(r"\n(?:[\x20\x09-\x0D]*\n)+")}
#: (least words of a unit that is hashed, least words of a run that is removed).
LEAST = {"line": (3, 15), "paragraph": (5, 5)}
_SPACE = re.compile(SPACE)


def unit_spans(text: str, unit: str = "line"):
    """(start, end, words) of each unit that isn't blank; the units and the blanks between them make up the whole text."""
    at = 0
    for end in (*(m.end() for m in ENDS[unit].finditer(text)), len(text)):
        if words := [w for w in _SPACE.split(text[at:end].lower()) if w]:
            yield at, end, words
        at = end


def repeated_runs(spans, repeats: set, min_words: int, run_words: int):
    """(start, end, units) of the removed runs: `repeats` has the starts of repeated units; units too short for a digest break no run."""
    start = end = units = total = 0
    for s, e, words in spans:
        if len(words) < min_words:
            continue
        if s in repeats:
            if not units:
                start = s
            end, units, total = e, units + 1, total + len(words)
            continue
        if total >= run_words:
            yield start, end, units
        units = total = 0
    if total >= run_words:
        yield start, end, units


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "line", min_words: int | None = None, run_words: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, removed_chars, spans ("start-end,..."), kept_text.

    Units of fewer than min_words words get no digest; between two repeats they count as part of the run.  Null text
    counts as empty.  Rows without doc_id have no rank: they come back whole and cause no removal.  Rows that repeat a
    doc_id are one document.  Empty tables give empty results; other columns are neither read nor returned.
    """
    least, run_least = (own if given is None else given for own, given in zip(LEAST[unit], (min_words, run_words)))

    def explode(batches):
        for batch in batches:
            ids, starts, digests = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is not None and t.is_valid:
                    for start, _, words in unit_spans(t.as_py(), unit):
                        if len(words) >= least:
                            ids.append(i)
                            starts.append(start)
                            digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64())], ["digest", "doc_id", "start"])

    def rebuild(batches):
        for batch in batches:
            out = []
            for i, t, gone in zip(*(batch.column(c) for c in ("doc_id", "text", "starts"))):
                whole = t.as_py() or ""
                spans = list(unit_spans(whole, unit))
                runs = list(repeated_runs(spans, set(gone.as_py()), least, run_least)) if gone.is_valid else []
                kept, at = [], 0
                for s, e, _ in runs:
                    kept.append(whole[at:s])
                    at = e
                kept.append(whole[at:])
                out.append((i.as_py(), len(spans), sum(n for _, _, n in runs), sum(e - s for s, e, _ in runs), ",".join(f"{s}-{e}" for s, e, _ in runs), "".join(kept)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_units", "n_removed", "removed_chars", "spans", "kept_text"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    units = cut(source.mapInArrow(explode, "digest binary, doc_id long, start long"))
    rank = F.struct("doc_id", "start")
    # Materialised, so that the join below is a stage of its own, whose hot digests adaptive execution can split.
    first = cut(units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first != last").select("digest", "first"))
    repeats = units.join(first, "digest").where(rank > F.col("first"))
    removed = cut(repeats.groupBy("doc_id").agg(F.collect_set("start").alias("starts")))
    joined = source.join(removed, "doc_id", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(rebuild, "doc_id long, n_units long, n_removed long, removed_chars long, spans string, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line
           FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*?(?:[.!?…]["''”’)\]]*[\x20\x09]+|[。！？]|\n)|[^\n]+') AS ls FROM documents)),
o AS (SELECT *, (coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s,
             list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
h AS (SELECT doc_id, k, s, s + length(line) AS e, len(w) AS words,
             row_number() OVER (PARTITION BY md5(array_to_string(w, ' ')) ORDER BY doc_id, s) > 1 AS again FROM o WHERE len(w) >= 3),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS island FROM h),
r AS (SELECT doc_id, min(k) AS lo, max(k) AS hi, min(s) AS s, max(e) AS e, count(*) AS units FROM i WHERE again
      GROUP BY doc_id, island HAVING sum(words) >= 15),
c AS (SELECT doc_id, sum(units)::BIGINT AS n_removed, sum(e - s)::BIGINT AS removed_chars, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM r GROUP BY doc_id),
t AS (SELECT o.doc_id, count(*) FILTER (len(w) > 0) AS n_units, string_agg(line, '' ORDER BY k) FILTER (lo IS NULL) AS kept_text
      FROM o LEFT JOIN r ON o.doc_id = r.doc_id AND k BETWEEN lo AND hi GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
       coalesce(spans, '') AS spans, coalesce(kept_text, '') AS kept_text
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
