"""The stages of corpus_pipeline.py, each against a plain version on its own input."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from quillstack.llm import mixing
from quillstack.llm.common import stored, table

from ..support import SMALL
from .conftest import DOCUMENTS
from .test_mixing import targets


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def outputs(spark):
    """Input and output of each stage over the small tables."""
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SMALL))
        out.append((name, docs, result))
        docs = result
    return out


def test_stages_keep_the_columns(outputs):
    assert [x[0] for x in outputs] == [x[0] for x in corpus_pipeline.STAGES]
    for _, _, result in outputs[:-1]:
        assert result.dtypes == [(f.name, f.dataType.simpleString()) for f in DOCUMENTS]


def test_language_stage_keeps_texts_and_drops_noise(spark, outputs):
    _, before, after = outputs[0]
    rows = {x["doc_id"]: x["text"] or "" for x in before.collect()}
    kept = {x["doc_id"] for x in after.collect()}
    for i, t in rows.items():
        letters = len(re.findall(r"[^\W\d_]", t))
        assert (i in kept) == (letters >= 3) or letters < 10


def test_exact_stage(outputs):
    _, before, after = outputs[1]
    first = {}
    for x in before.collect():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", x["text"] or "")
        first[t] = min(x["doc_id"], first.get(t, x["doc_id"]))
    assert sorted(x["doc_id"] for x in after.collect()) == sorted(first.values())


def test_near_stage_against_exact_similarity(outputs):
    _, before, after = outputs[2]
    rows = {x["doc_id"]: shingles(x["text"] or "") for x in before.collect()}
    kept = {x["doc_id"] for x in after.collect()}
    best = {i: max((len(s & t) / len(s | t) for j, t in rows.items() if j != i), default=0) for i, s in rows.items()}
    assert all(i in kept for i in rows if best[i] < 0.6)
    for i in rows:
        if any(len(rows[i] & t) / len(rows[i] | t) > 0.9 for j, t in rows.items() if j < i):
            assert i not in kept


def test_mixing_stage(outputs):
    _, before, after = outputs[3]
    rows = before.collect()
    size = {x["doc_id"]: len(re.findall(mixing.WORD, x["text"] or "")) for x in rows}
    by_source, taken = Counter(), Counter()
    for x in rows:
        by_source[x["source"]] += size[x["doc_id"]]
    copies = Counter(x["doc_id"] for x in after.collect())
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    source = {x["doc_id"]: x["source"] for x in rows}
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    for s, want in targets(by_source).items():
        assert abs(taken[s] - want) <= 2 * max(size[i] for i in size if source[i] == s)


def test_packing_stage(outputs):
    from .test_packing import whole

    _, before, after = outputs[4]
    docs, bins = whole(after.collect())
    copies = Counter(x["doc_id"] for x in before.collect())
    size = {x["doc_id"]: len(re.findall(mixing.WORD, x["text"] or "")) for x in before.collect()}
    assert {i: sum(n for _, n in p) for i, p in docs.items()} == {i: n * size[i] for i, n in copies.items()}


def test_run_applies_the_stages(spark, outputs):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, outputs[-1][2].collect()), key=repr)


def test_odd_documents_pass_through_every_stage(spark, documents):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("the and of to in that is with for this".split()) + str(i) * (k % 9 == 0) for k in range(60)), r.choice(["en", None]), r.choice(["a", "b", None])) for i in range(50)]
    rows += [(50, None, None, None), (51, "", "en", "a"), (52, "the and of " * 50_000, "en", "a"), (3, rows[3][1], "en", "a"), (None, "the and of to in that", "en", "a")]
    for df in (documents(rows), documents(rows, clash=True), documents([])):
        for _, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, ""))
        assert "bin_id" in df.columns


def test_entry_registers_every_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("stage", [x[1] for x in corpus_pipeline.STAGES[:3]], ids=[x[0] for x in corpus_pipeline.STAGES[:3]])
def test_other_texts_of_a_dropped_id_stay(spark, documents, stage):
    r = random.Random(2)
    words = "the and of to in that is with for this".split()
    first, other = (" ".join(r.choice(words) + str(r.randrange(9)) for _ in range(60)) for _ in range(2))
    rows = [(1, first, "en", "a"), (5, first, "en", "a"), (5, other, "en", "a"), (6, "1 2 3", "en", "a"), (6, other + " once more", "en", "a")]
    got = Counter((x["doc_id"], x["text"]) for x in stage(spark, documents(rows, clash=True), "").collect())
    assert got[1, first] == 1
    assert got[5, other] == 1
    if stage is corpus_pipeline.language:
        assert got[6, "1 2 3"] == 0 and got[6, other + " once more"] == 1
    else:
        assert got[5, first] == 0
