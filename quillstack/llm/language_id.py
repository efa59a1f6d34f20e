"""Operator 6, language ID by Bayesian evidence fusion.

Per document: log P(text | l) of a character-trigram model, P(declared language | l), P(address suffix | l), and a host
prior P(l | host) that is smoothed towards its domain's, which is smoothed towards the whole table's.  The last three
come from grouped sums of the text model's posteriors over all rows; a row's own share is taken out of its host's and
domain's counts.  The model's trigram counts come from all rows of a labelled table.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Languages where no table says which there are.
LANGUAGES = ("de", "en", "es", "fr")
SLOTS = 1 << 16
#: A text's evidence counts as that of this many trigrams at most, as neighbouring trigrams aren't independent.
EVIDENCE = 60
#: Pseudo-counts: trigrams, host towards domain and domain towards everything, declared language and suffix.
TRIGRAM_PRIOR, HOST_PRIOR, FIELD_PRIOR = 0.05, 5.0, 5.0
#: A document is rejected if it has fewer trigrams of letters, if its mean log-likelihood by the best language is
#: lower (uniform noise has about -11, natural text -5 to -8), or if the posterior of its language is lower.
MIN_TRIGRAMS, MIN_FIT, MIN_CONFIDENCE = 3, -10.8, 0.5
BLOCK = 1 << 20

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*+>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-zA-Z]+)|<meta\b[^>]*?content-language[\"']?[^>]*?content\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def trigrams(text: str):
    """Slots of the letter trigrams of `text`, in pieces of about a megabyte that join without a seam."""
    carried, after_letter = np.array([32], np.uint32), False  # the last codes of the piece before
    for at in range(0, len(text) + 1, BLOCK):
        piece = text[at : at + BLOCK].lower() + (" " if at + BLOCK > len(text) else "")
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            continue
        letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x303F)))
        kept = np.where(letter, codes, 32)[letter | np.r_[after_letter, letter[:-1]]]
        codes, after_letter = np.concatenate([carried, kept]).astype(np.uint32), bool(letter[-1])
        carried = codes[-2:]
        if len(codes) > 2:
            h = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)
            h ^= h >> np.uint32(15)
            yield (h * np.uint32(668265263)) >> np.uint32(16)


def languages_of(docs: DataFrame, label: str = "lang", most: int = 64, share: float = 0.001) -> tuple[str, ...]:
    """The labels of at least `share` of the labelled rows, `most` at most, the most frequent first in doubt; LANGUAGES if there is none."""
    counts = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("l")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "l").limit(most).collect()
    total = sum(x["n"] for x in top)
    return tuple(sorted(x["l"] for x in top if x["n"] >= share * total)) or LANGUAGES


def fit(docs: DataFrame, text: str = "text", label: str = "lang", languages=LANGUAGES) -> np.ndarray:
    """Log-probabilities (slot, language), from counts over all rows whose label is one of the languages.

    What reaches the driver is SLOTS x languages counts at most.
    """
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        sums = np.zeros((len(languages), SLOTS), np.int64)
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for slots in trigrams(t.as_py() or "") if lang in index else ():
                    sums[index[lang]] += np.bincount(slots, minlength=SLOTS)
        lang, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(slot, pa.int64()), pa.array(sums[lang, slot])], ["l", "slot", "n"])

    counted = docs.select(F.col(label).alias("l"), F.col(text).alias("t")).mapInArrow(count, "l long, slot long, n long")
    got = counted.groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.full((SLOTS, len(languages)), TRIGRAM_PRIOR)
    sums[got["slot"].to_numpy(), got["l"].to_numpy()] += got["n"].to_numpy()
    return np.log(sums / sums.sum(0)).astype(np.float32)


def host_parts(url: str | None):
    """(host, domain, suffix) of an address; nulls where it has none."""
    try:
        host = (urlsplit(url or "").hostname or "").rstrip(".").lower()
    except ValueError:
        host = ""
    labels = host.split(".")
    named = len(labels) > 1 and not labels[-1].isdigit()
    return (host or None), (".".join(labels[-2:]) if named else host or None), (labels[-1] if named else None)


def visible_text(html: str) -> str:
    return unescape(_MARKUP.sub(" ", html))


def declared_language(html: str) -> str | None:
    m = _DECLARED.search(html)
    return (m[1] or m[2]).lower() if m else None


def text_evidence(rows: DataFrame, model, languages=LANGUAGES, markup: bool = False) -> DataFrame:
    """id, host, domain, suffix, declared, n, fit, and per language e<i> (log-likelihood) and q<i> (posterior).

    `rows` has id, text, declared, address; of markup, the visible text and the declared language are taken.
    """
    L = len(languages)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["id", "host", "domain", "suffix", "declared", "n", "fit", *(f"e{i}" for i in range(L)), *(f"q{i}" for i in range(L))]

    def run(batches):
        logp = shared.value
        for batch in batches:
            parts, declared, n, fits, e = [], batch.column("declared").to_pylist(), [], [], np.zeros((batch.num_rows, L))
            for i, (t, address) in enumerate(zip(batch.column("text"), batch.column("address").to_pylist())):
                text = t.as_py() or ""
                if markup:
                    declared[i] = declared_language(text)
                    text = visible_text(text)
                    parts.append(host_parts(address))
                else:
                    parts.append((address, None, None))
                total, seen = np.zeros(L), 0
                for slots in trigrams(text):
                    total += logp[slots].sum(0, dtype=np.float64)
                    seen += len(slots)
                n.append(seen)
                fits.append(float(total.max() / seen) if seen else 0.0)
                e[i] = total * (min(seen, EVIDENCE) / seen) if seen else 0.0
            q = np.exp(e - e.max(1, keepdims=True)) if len(e) else e
            q = q / q.sum(1, keepdims=True) if len(q) else q
            host, domain, suffix = zip(*parts) if parts else ((), (), ())
            texts = [pa.array(x, pa.string()) for x in (host, domain, suffix, declared)]
            numbers = [pa.array(n, pa.int64()), pa.array(fits, pa.float64()), *(pa.array(x[:, i]) for x in (e, q) for i in range(L))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *texts, *numbers], names)

    schema = "id long, host string, domain string, suffix string, declared string, n long, fit double, " + ", ".join(f"{c} double" for c in names[7:])
    return rows.select("id", "text", "declared", "address").mapInArrow(run, schema)


def fuse(evidence: DataFrame, languages=LANGUAGES) -> DataFrame:
    """id, host, declared, suffix, text_lang, lang, confidence, accepted for text_evidence() rows (materialised).

    A missing host, suffix or declared language is no evidence.  lang is null if rejected for want of text.
    """
    ids = range(len(languages))
    sums = lambda prefix: [F.sum(f"q{i}").alias(f"{prefix}{i}") for i in ids]
    read = F.col("n") >= MIN_TRIGRAMS
    used = evidence.where(read)
    whole = used.agg(*sums("a"), F.count("*").alias("a"))
    host = used.where("host IS NOT NULL").groupBy("host", "domain").agg(*sums("h"), F.count("*").alias("h"))
    domain = used.where("domain IS NOT NULL").groupBy("domain").agg(*sums("d"), F.count("*").alias("d"))
    # A row of `whole` only: a join with it is a constant per row.
    e = evidence.join(host, (evidence.host == host.host) & evidence.domain.eqNullSafe(host.domain), "left").drop(host.host).drop(host.domain)
    e = e.join(domain, "domain", "left")
    for field in ("declared", "suffix"):
        seen = used.where(F.col(field).isNotNull()).groupBy(field).agg(*sums(field[0]), F.count("*").alias(field[0]))
        seen = seen.select(field, *(F.col(f"{field[0]}{i}").alias(f"{field}{i}") for i in ids), F.col(field[0]).alias(field + "_n"))
        e = e.join(seen, field, "left")
    e = e.join(F.broadcast(whole), how="cross")

    def score(i):
        own, one = F.when(read, F.col(f"q{i}")).otherwise(0.0), F.when(read, 1).otherwise(0)
        at_all = (F.col(f"a{i}") + 1) / (F.col("a") + len(languages))
        at_domain = (F.coalesce(F.col(f"d{i}") - own, F.lit(0.0)) + HOST_PRIOR * at_all) / (F.coalesce(F.col("d") - one, F.lit(0)) + HOST_PRIOR)
        at_host = (F.coalesce(F.col(f"h{i}") - own, F.lit(0.0)) + HOST_PRIOR * at_domain) / (F.coalesce(F.col("h") - one, F.lit(0)) + HOST_PRIOR)
        total = F.col(f"e{i}") + F.ln(F.greatest(at_host, F.lit(1e-9)))
        for field in ("declared", "suffix"):
            share = (F.col(field + "_n") + 1) / (F.col("a") + 2)
            given = (F.col(f"{field}{i}") + FIELD_PRIOR * share) / (F.col(f"a{i}") + FIELD_PRIOR)
            total = total + F.coalesce(F.ln(given) - F.ln(share), F.lit(0.0))
        return total

    scored = e.select("id", "host", "declared", "suffix", "n", "fit", *(score(i).alias(f"s{i}") for i in ids), *(F.col(f"q{i}") for i in ids))
    pick = lambda prefix: F.array_max(F.array(*(F.struct(F.col(f"{prefix}{i}").alias("v"), F.lit(x).alias("l")) for i, x in enumerate(languages))))
    scored = scored.withColumn("best", pick("s"))
    spread = sum((F.exp(F.col(f"s{i}") - F.col("best.v")) for i in ids), F.lit(0.0))
    lang = F.when(F.col("n") >= MIN_TRIGRAMS, F.col("best.l"))
    confidence = F.when(F.col("n") >= MIN_TRIGRAMS, 1 / spread).otherwise(0.0)
    out = scored.select("id", "host", "declared", "suffix", "n", "fit", F.when(F.col("n") >= MIN_TRIGRAMS, pick("q")["l"]).alias("text_lang"), lang.alias("lang"), confidence.alias("confidence"))
    return out.withColumn("accepted", F.col("lang").isNotNull() & (F.col("fit") >= MIN_FIT) & (F.col("confidence") >= MIN_CONFIDENCE))


def identify_pages(pages: DataFrame, model, languages=LANGUAGES) -> DataFrame:
    """One row per input row: page_id, host, declared, suffix, n, fit, text_lang, lang, confidence, accepted.

    Null html counts as empty and is rejected; a null or unreadable address is no evidence.  Repeated rows give
    repeated results, empty tables empty ones; other columns are neither read nor returned.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"), F.col("url").cast("string").alias("address"))
    return fuse(cut(text_evidence(rows, model, languages, markup=True)), languages).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, model, languages=LANGUAGES) -> DataFrame:
    """As identify_pages(), with the lang column as declared language and the source as host; doc_id for page_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("address"))
    return fuse(cut(text_evidence(rows, model, languages)), languages).withColumnRenamed("id", "doc_id")


def keep_identified(docs: DataFrame, languages=None) -> DataFrame:
    """`docs` without the documents that are rejected; rows without doc_id stay.  Languages are those of the labels."""
    languages = languages or languages_of(docs)
    # Judged by all that is read of a row, as rows of one doc_id may differ.
    mark = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text", "lang", "source"))
    judged = identify_documents(docs.select(mark.alias("doc_id"), "text", "lang", "source"), fit(docs, languages=languages), languages)
    name = fresh(docs, "mark")
    rejected = judged.where("NOT accepted AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, mark).join(rejected, name, "left_anti").select(docs.columns)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = languages_of(docs)
    return identify_pages(table(spark, sf_dir, "pages"), fit(docs, languages=languages), languages)
