import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import suffix_array
from quillstack.llm.common import table

from ..support import SMALL
from .conftest import rows_of

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, width=100):
    first, out = {}, []
    order = sorted({(i, (t or "").encode()) for i, t in rows if i is not None})
    gone = {}
    for i, data in order:
        cover = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - width + 1):
            if first.setdefault(data[s : s + width], (i, s)) != (i, s):
                cover[s : s + width] = True
        gone[i] = cover
    for i, t in rows:
        data = (t or "").encode()
        cover = gone.get(i, np.zeros(len(data) + 1, bool))
        kept = bytes(b for b, c in zip(data, cover) if not c)
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((i, len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words(r, n, vocabulary=5000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_edges_against_brute_force(documents):
    r = random.Random(2)
    a, b = words(r, 60), words(r, 80)
    rows = [(3, a), (1, b + a), (2, None), (4, ""), (5, a[:99]), (6, a[7:107]), (7, a[1:101] + "x" + a[40:200]), (8, "z" * 99), (9, "z" * 100), (10, "z" * 700), (11, "z" * 150), (None, a), (12, "é" * 80 + b), (13, "ü" + "é" * 80), (14, a + a + a), (14, a + a + a)]
    assert rows_of(suffix_array.remove_repeated_strings(documents(rows, clash=True)), *COLUMNS) == brute(rows)


def test_shared_passages_against_brute_force(documents):
    r = random.Random(4)
    passages = [words(r, r.randrange(10, 60)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [words(r, r.randrange(1, 60))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            parts += [p[cut:] if r.random() < 0.3 else p, words(r, r.randrange(0, 20))]
        rows.append((r.randrange(10**6) * 1000 + i, " ".join(parts)))
    assert rows_of(suffix_array.remove_repeated_strings(documents(rows)), *COLUMNS) == brute(rows)


def test_periodic_and_near_equal_texts(documents):
    r = random.Random(6)
    base = words(r, 300)
    rows = [(i, base[: 17 * i] + f"<{i}>" + base[17 * i :]) for i in range(40)] + [(100 + i, "abcab" * (20 + i)) for i in range(20)] + [(200, "ab" * 900), (201, "ba" * 400)]
    assert rows_of(suffix_array.remove_repeated_strings(documents(rows)), *COLUMNS) == brute(rows)


def test_crowded_anchors(documents, monkeypatch):
    monkeypatch.setattr(suffix_array, "MAX_CONTEXTS", 5)
    r = random.Random(8)
    shared = words(r, 25)
    rows = [(i, words(r, 8) + " " + shared + " " + words(r, 8)) for i in range(60)]
    assert rows_of(suffix_array.remove_repeated_strings(documents(rows)), *COLUMNS) == brute(rows)


def test_long_texts_are_cut_with_overlap(documents, monkeypatch):
    monkeypatch.setattr(suffix_array, "CHUNK_BYTES", 2000)
    r = random.Random(10)
    a, b = words(r, 3000), words(r, 200)
    rows = [(1, a), (2, a[5000:9000] + b + a[100:]), (3, b)]
    assert rows_of(suffix_array.remove_repeated_strings(documents(rows)), *COLUMNS) == brute(rows)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300).map(lambda x: bytes(b % 4 + 97 for b in x)))
def test_two_stage_sorts_suffixes(data):
    got = suffix_array.two_stage(np.frombuffer(data, np.uint8), 400)
    assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    wanted = np.arange(len(data)) % 7 < 3
    got = suffix_array.two_stage(np.frombuffer(data, np.uint8), 400, wanted)
    assert got.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: data[i:])


def test_small_table_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert rows_of(suffix_array.op9_suffix_array(spark, SMALL), *COLUMNS) == brute(rows)


def test_empty_table(documents):
    assert suffix_array.remove_repeated_strings(documents([])).count() == 0
