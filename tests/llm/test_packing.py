import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import packing
from quillstack.llm.common import table

from ..support import SMALL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_pack_against_a_plain_best_fit(sizes):
    lengths = (16, 32, 64)
    bins, offsets, capacity = packing.pack(sizes, lengths)
    rooms, left, plain = [], sum(sizes), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # stable
        n = sizes[i]
        left -= n
        fit = [b for b in range(len(rooms)) if rooms[b] >= n]
        if fit:
            tight = min(rooms[b] for b in fit)
            assert rooms[bins[i]] == tight  # as full as any open bin can be
            b = bins[i]
        else:
            b = len(rooms)
            rooms.append(min((x for x in lengths if x >= n), key=lambda x: (packing.cost(x) / min(x, n + left), x)))
            assert bins[i] == b
        rooms[b] -= n
        plain.setdefault(b, []).append(i)
    for b, members in plain.items():
        used = sum(sizes[i] for i in members)
        assert capacity[b] == min(x for x in lengths if x >= used)
        taken = sorted((offsets[i], offsets[i] + sizes[i]) for i in members)
        assert taken[0][0] == 0 and taken[-1][1] == used and all(a[1] == b[0] for a, b in zip(taken, taken[1:]))


def whole(rows, lengths=packing.LENGTHS):
    """Checks that pieces cover each document, that bins hold them without overlap, and gives the bins."""
    docs, bins = {}, {}
    for x in rows:
        docs.setdefault(x["doc_id"], []).append((x["start"], x["n_tokens"]))
        if x["n_tokens"]:
            bins.setdefault(x["bin_id"], []).append(x)
        else:
            assert x["bin_id"] is None and x["capacity"] is None and x["position"] is None
    for members in bins.values():
        members.sort(key=lambda x: x["position"])
        at = 0
        for x in members:
            assert x["position"] == at
            at += x["n_tokens"]
        assert {x["capacity"] for x in members} == {min(n for n in lengths if n >= at)}
    return docs, bins


def test_small_table(spark):
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in table(spark, SMALL, "documents").collect()}
    docs, bins = whole(packing.op4_packing(spark, SMALL).collect())
    assert docs.keys() == sizes.keys()
    for i, pieces in docs.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == sizes[i]
    room = sum(m[0]["capacity"] for m in bins.values())
    assert sum(sizes.values()) / room > 0.95


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, "w " * 20_000), (4, "w"), (4, "w"), (None, "a b c")]
    docs, bins = whole(packing.pack_documents(documents(rows, clash=True)).collect())
    assert sorted(docs[3]) == [(0, 8192), (8192, 8192), (16384, 3616)]
    assert docs[4] == [(0, 1), (0, 1)] and docs[None] == [(0, 3)] and docs[1] == docs[2] == [(0, 0)]
    assert packing.pack_documents(documents([])).count() == 0


def test_shards_lose_little(documents):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 900)) for i in range(3000)]
    total = sum(len(t.split()) for _, t in rows)
    room = []
    for pieces in (500, 10**6):
        _, bins = whole(packing.pack_documents(documents(rows), shard_pieces=pieces).collect())
        room.append(sum(m[0]["capacity"] for m in bins.values()))
        assert total / room[-1] > 0.97
    assert room[0] <= 1.01 * room[1]  # shards of 500 pieces against one shard for all


def test_ranges_give_the_texts_back(documents):
    """Pieces make up each text exactly, each has the words it tells, and the sequences' texts have the bins' lengths."""
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["é", "w", "漢", "😀x"]) * r.randrange(1, 4) + r.choice([" ", "\n\n", "\t "]) for _ in range(r.randrange(0, 90)))) for i in range(40)]
    rows += [(40, "  lead and trail \n"), (41, None), (42, ""), (43, " \n"), (None, "a b"), (None, "c d e f g h i j k l m n o p"), (44, "x " * 200_000), (1, "other text of one")]
    got = packing.pack_documents(documents(rows, clash=True), lengths=(4, 8, 16), with_text=True).collect()
    found = {}
    for x in sorted(got, key=lambda x: x["char_start"]):
        assert len(x["text"].split()) == x["n_tokens"] and len(x["text"]) == x["char_end"] - x["char_start"]
        if x["doc_id"] not in (1, None):
            found[x["doc_id"]] = found.get(x["doc_id"], "") + x["text"]
    assert found == {i: t or "" for i, t in rows if i not in (1, None)}
    whole(got, (4, 8, 16))
    assert sorted(x["text"] for x in got if x["doc_id"] is None and x["n_tokens"] == 2) == ["a b"]


def test_crowds_spread_over_shards(spark, documents):
    """Rows without doc_id and repeated rows: no shard gets much more than its share, and none is lost."""
    rows = [(None, f"text {i}") for i in range(3000)] + [(7, "same words again")] * 3000
    got = packing.pack_documents(documents(rows), shard_pieces=500).collect()
    by_shard = {}
    for x in got:
        by_shard[x["bin_id"] >> 32] = by_shard.get(x["bin_id"] >> 32, 0) + 1
    assert len(got) == 6000 and len(by_shard) == 12 and max(by_shard.values()) < 700
    whole(got)


def test_joint_choice_of_lengths_costs_no_more_than_one_length():
    sizes = np.random.default_rng(3).integers(1, 3000, 2000)
    of = lambda lengths: sum(map(packing.cost, packing.pack(sizes, lengths)[2].tolist()))
    assert of(packing.LENGTHS) <= min(of((n,)) for n in packing.LENGTHS if n >= 3000)
