"""Operator 5, toxicity: a counterfactual-regularised linear classifier.

Features are hashed words and word prefixes at doubling shares of a text's words: at all, at least 1/512 of them, 1/256
and so on.  Those whose log-likelihood ratio with the label is significant on a bounded sample of labelled rows are
fitted by logistic regression, which minimises log loss + LAMBDA * (z(x) - z(x'))^2 over documents with an identity
term, where x' has its identity terms swapped for others of their kind: what merely names a group can't move the
score.  Every whole text is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Hash values of words and prefixes; each has a slot for its presence and for LEVELS shares, the least being 1/512.
BASES, LEVELS = 1 << 19, 8
SLOTS = BASES * (LEVELS + 1)
PREFIXES = (3, 4, 5, 6)
#: At most this many training documents of each label: those with the smallest hash of doc_id.
MAX_PER_LABEL = (4500, 3000)
#: Least log-likelihood ratio (chi-squared with one degree of freedom) of a feature that is fitted.
SIGNIFICANT = 12.0
LAMBDA, L2, STEPS = 2.0, 3e-4, 300
BLOCK = 1 << 20

#: Terms of one kind, per language; a swap takes the next term of the kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("she", "he"), ("her", "his"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"), ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "citizens", "refugees", "natives"), ("disabled", "deaf", "blind", "autistic"), ("elderly", "young"),
    ("africans", "europeans", "americans", "asians", "arabs"), ("african", "european", "american", "arab", "mexican"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("ausländer", "inländer"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"), ("immigrés", "citoyens"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "latinos"), ("inmigrantes", "ciudadanos"),
)
SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, term in enumerate(kind)}
_EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "…«»„“”‘’¿¡–—"


class Features:
    """Bases and slots of texts, with a bounded memory of words seen before; given `hot`, of those bases only."""

    def __init__(self, hot: dict | None = None):
        self.known: dict[str, tuple] = {}
        self.hot = hot

    def of(self, word: str) -> tuple:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            bare = word.strip(_EDGE)
            data = [bare] + [f"{n}\t{bare[:n]}" for n in PREFIXES if len(bare) >= n] if bare else []
            bases = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BASES for x in data]
            got = self.known[word] = tuple(bases if self.hot is None else [b for b in bases if b in self.hot])
        return got

    def levels(self, text: str, swap: bool = False) -> tuple[dict[int, int], bool]:
        """Level of each base of a whole text, and whether the text names a group."""
        counts: dict[int, int] = {}
        named, at, total = False, 0, 0
        while at < len(text):
            end = text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            for word, n in Counter(text[at:end].lower().split()).items():
                total += n
                if self.hot is None:
                    other = SWAP.get(word.strip(_EDGE))
                    named = named or other is not None
                    word = other if swap and other else word
                for base in self.of(word):
                    counts[base] = counts.get(base, 0) + n
            at = end
        return {base: min(LEVELS, max(0, (n * 1024 // total).bit_length() - 1)) for base, n in counts.items()}, named

    def slots(self, text: str, swap: bool = False) -> tuple[np.ndarray, bool]:
        """A slot for each base and level up to the text's."""
        found, named = self.levels(text, swap)
        base, level = (np.fromiter(x, np.int64, len(found)) for x in (found.keys(), found.values()))
        base, level = np.repeat(base * (LEVELS + 1), level + 1), level + 1
        return (base + np.arange(len(base)) - np.repeat(np.cumsum(level) - level, level)).astype(np.int32), named


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label=MAX_PER_LABEL) -> DataFrame:
    """id, y, text of at most sum(per_label) labelled documents outside the held-out fold, materialised."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = marked.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    # The smallest hashes make the sample.  A bound on the hash leaves half as many rows again as are wanted, so that
    # sorting them takes one small task at any number of labels.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    marked = cut(marked.withColumn("place", place))
    seen = dict(marked.groupBy("y").count().collect())
    parts = []
    for y, n in enumerate(per_label):
        bound = int(min(1.0, 1.5 * n / max(1, seen.get(y, 0)) if seen.get(y, 0) > 2 * n else 1.0) * (1 << 31))
        parts.append(marked.where((F.col("y") == y) & (F.col("place") < bound)).orderBy("place", "doc_id").limit(n).drop("place"))
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select(F.col("doc_id").alias("id"), "y", "text"))


def significant_slots(sample: DataFrame, n: int, toxic: int, least: float = SIGNIFICANT) -> pa.Table:
    """(slot, ratio) of the slots whose log-likelihood ratio is over `least`: twice the gain in log likelihood of the
    labels when those of texts with and without the slot are told apart."""

    def count(batches):
        features, seen, bad = Features(), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                x = features.slots(t.as_py())[0]
                seen[x] += 1
                if y:
                    bad[x] += 1
        slot = np.flatnonzero(seen)
        for at in range(0, len(slot), 1 << 16):
            part = slot[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (part, seen[part], bad[part])], ["slot", "k", "a"])

    e = lambda v: F.when(v > 0, v * F.ln(v)).otherwise(0.0)
    counts = sample.select("y", "text").mapInArrow(count, "slot long, k long, a long").groupBy("slot").agg(F.sum("k").alias("k"), F.sum("a").alias("a"))
    k, a, all_, ones = F.col("k"), F.col("a"), F.lit(n), F.lit(toxic)
    ratio = 2 * (e(a) + e(k - a) + e(ones - a) + e(all_ - ones - k + a) - e(k) - e(all_ - k) + e(all_) - e(ones) - e(all_ - ones))
    return counts.where("k > 1").select("slot", ratio.alias("ratio")).where(F.col("ratio") > least).toArrow().sort_by("slot")


def slot_places(sample: DataFrame, used: np.ndarray) -> pa.Table:
    """id, y, x, other: each text's slots as places in `used`, and those of the text with identity terms swapped (null
    if it has none)."""

    def run(batches):
        features, place = Features(), np.full(SLOTS, -1, np.int32)
        place[used] = np.arange(len(used))
        of = lambda x: (p := place[x])[p >= 0]
        for batch in batches:
            xs, others = [], []
            for t in batch.column("text"):
                text = t.as_py()
                x, named = features.slots(text)
                xs.append(of(x))
                others.append(of(features.slots(text, swap=True)[0]) if named else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(xs, kind), pa.array(others, kind)], ["id", "y", "x", "other"])

    return sample.mapInArrow(run, "id long, y int, x array<int>, other array<int>").toArrow().sort_by("id")


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    """(member, list) of every member of lists."""
    return np.concatenate([np.empty(0, np.int32), *lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def train(xs, ys, others, used: np.ndarray, ratio: np.ndarray, lam: float = LAMBDA, steps: int = STEPS) -> tuple[dict, float]:
    """(base -> summed weights up to each level, bias) from texts' places in `used`.

    others: the swapped version of each text, or None.
    """
    y = np.asarray(ys, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    s = 3 * np.sqrt(ratio / len(y))
    a, row = _ragged(xs)
    pairs = [i for i, o in enumerate(others) if o is not None]
    b, prow = _ragged([xs[i] for i in pairs])
    c, crow = _ragged([others[i] for i in pairs])
    b, prow, psign = np.r_[b, c], np.r_[prow, crow], np.r_[np.ones(len(b)), -np.ones(len(c))]
    balance = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0)) ** 0.5
    w, bias, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=(w * s)[a], minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(y)
        grad = np.bincount(a, weights=error[row], minlength=len(used)) * s + L2 * w
        if pairs:
            gap = np.bincount(prow, weights=psign * (w * s)[b], minlength=len(pairs))
            grad += np.bincount(b, weights=psign * gap[prow], minlength=len(used)) * s * (2 * lam / len(pairs))
        g = np.r_[grad, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    bases, row = np.unique(used // (LEVELS + 1), return_inverse=True)
    steps_of = np.zeros((len(bases), LEVELS + 1))
    steps_of[row, used % (LEVELS + 1)] = w * s
    return dict(zip(bases.tolist(), steps_of.cumsum(1).tolist())), float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", lam: float = LAMBDA) -> tuple[dict, float]:
    """A model of some thousand weights at most; without documents of either label it is a constant."""
    sample = training_sample(docs, labels, label)
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if toxic in (0, n):
        return {}, 5.0 if toxic else -5.0
    found = significant_slots(sample, n, toxic)
    used = found["slot"].to_numpy()
    got = slot_places(sample, used)
    lists = lambda c: [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in got[c]]
    return train(lists("x"), got["y"].to_numpy(), lists("other"), used, found["ratio"].to_numpy(), lam)


def score(docs: DataFrame, model: tuple[dict, float]) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without features.  A null doc_id is held out of nothing (false).
    Repeated rows give repeated results, empty tables empty ones; other columns are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # significant features of a bounded sample: some thousand

    def run(batches):
        hot, bias = shared.value
        features = Features(hot)
        for batch in batches:
            z = [bias + sum(hot[base][level] for base, level in features.levels(t.as_py() or "")[0].items()) for t in batch.column("text")]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
