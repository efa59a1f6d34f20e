import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quillstack.llm import toxicity
from quillstack.llm.common import table

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("quality", T.IntegerType())])
INSULTS = ("idiot", "moron", "scum", "trash")


def corpus(n=600, seed=1, insulted=1.0):
    """(doc_id, text, toxic): insults are in this share of the toxic texts, the word women in many of them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(300)}" for _ in range(r.randrange(20, 60))]
        toxic = i % 3 == 0
        if toxic and r.random() < insulted:
            words[::9] = [r.choice(INSULTS) for _ in words[::9]]
        if r.random() < (0.6 if toxic else 0.05):
            words[3] = "women"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark, documents):
    rows = corpus()
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows], LABELS)
    got = {x["doc_id"]: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    held = [(y, got[i]["score"]) for i, _, y in rows if got[i]["held_out"]]
    y, s = map(np.array, zip(*held))
    assert auc(y, s) > 0.99 and ((s >= 0.5) == y).mean() > 0.97


def test_naming_a_group_alone_moves_little(spark, documents):
    rows = corpus(insulted=0.6)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows], LABELS)

    def gap(lam):
        hot, _ = toxicity.fit(docs, labels, lam=lam)
        scorer = toxicity.Features(hot)
        z = lambda t: sum(hot[b][k] for b, k in scorer.levels(t)[0].items())
        neutral = "w1 w2 w3 w4 the women w5 w6 w7"
        return z(neutral) - z(neutral.replace("women", "people"))

    assert gap(0.0) > 0.3
    assert abs(gap(20.0)) < 0.3 * gap(0.0)


def test_labels_of_the_held_out_fold_change_nothing(spark, documents):
    rows = corpus(200)
    docs = documents([(i, t) for i, t, _ in rows])
    of = lambda flip: toxicity.fit(docs, spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y, None) for i, _, y in rows], LABELS))
    assert of(False) == of(True)


def test_the_sample_is_bounded_and_takes_the_smallest_hashes(spark, documents):
    rows = [(i, f"w{i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i, _ in rows], LABELS)
    whole = {x["id"]: x["y"] for x in toxicity.training_sample(documents(rows), labels).collect()}
    part = {x["id"]: x["y"] for x in toxicity.training_sample(documents(rows), labels, per_label=(200, 100)).collect()}
    assert len(whole) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    assert sum(part.values()) == 100 and len(part) == 300 and part.items() <= whole.items()


def test_edges(spark, documents):
    rows = corpus(200)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, None), (3, None, None), (10**6, 1, None)], LABELS)
    model = toxicity.fit(docs, labels)
    odd = documents([(1, None), (2, ""), (3, "scum " * 300_000), (3, "scum " * 300_000), (None, "w1 w2"), (5, "IDIOT!  «moron» scum trash")], clash=True)
    got = [tuple(x) for x in toxicity.score(odd, model).collect()]
    assert len(got) == 6
    scores = {i: s for i, _, s, _ in got}
    assert scores[1] == scores[2] < 0.5 < scores[5] and scores[3] > 0.5
    assert {h for i, h, _, _ in got if i is None} == {False}
    assert toxicity.score(documents([]), model).count() == 0
    assert toxicity.fit(documents([]), labels) == ({}, -5.0)
    assert toxicity.fit(docs, spark.createDataFrame([], LABELS)) == ({}, -5.0)


def test_long_texts_are_read_whole_and_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(5000)) + " scum"
    whole = toxicity.Features().levels(text)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert toxicity.Features().levels(text) == whole
    assert whole[0][zlib.crc32(b"scum") % toxicity.BASES] == 0


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, sf)
    assert got.count() == table(spark, sf, "documents").count()
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "score").collect()
    y, s = (np.array(x) for x in zip(*map(tuple, rows)))
    assert auc(y, s) > 0.8
    assert ((s >= 0.5) & (y == 0)).sum() <= 1
    assert ((s >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("swap", [False, True])
def test_swaps_stay_in_their_kind(swap):
    features = toxicity.Features()
    x, named = features.slots("the women spoke", swap=swap)
    y, _ = features.slots("the men spoke" if swap else "the women spoke")
    assert named and sorted(x) == sorted(y)
