import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from quillstack.llm import shingle_join, simhash
from quillstack.llm.common import table

from ..support import SMALL
from .conftest import rows_of


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


COLUMNS = ("doc_id", "fingerprint", "component_id")


def test_edges_against_brute_force(documents):
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    rows = [(9, None), (4, ""), (6, " \t"), (1, "One"), (2, "one"), (3, "one two"), (5, "a b c d"), (7, "A b C d"), (7, "A b C d"), (8, "é À b c"), (10, long), (11, long + " end")]
    assert rows_of(simhash.near_groups(documents(rows, clash=True)), *COLUMNS) == brute(rows)


def test_near_texts_against_brute_force(documents):
    r = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{r.randrange(900)}" for _ in range(400)]
        for k in range(r.randrange(1, 5)):
            words = list(words)
            words[r.randrange(400)] = "edit"
            rows.append((1000 - 10 * i + k, " ".join(words)))
    want = brute(rows)
    assert len({x[2] for x in want}) < len(rows)
    assert rows_of(simhash.near_groups(documents(rows)), *COLUMNS) == want


@pytest.mark.parametrize("near", [1, 2, 3])
def test_every_link_is_found(spark, near):
    """Fingerprints at exactly `near` bits from each other, whatever the bits."""
    r = random.Random(near)
    rows = []
    for i in range(300):
        f = r.getrandbits(64)
        for g in (f, f ^ sum(1 << b for b in r.sample(range(64), near))):
            rows.append((len(rows), int(np.uint64(g).view(np.int64))))
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, f0 long"))
    assert all(x["component_id"] == x["doc_id"] // 2 * 2 for x in got.collect())


def test_chains_link_and_long_lists_work(spark):
    rows = [(k, (1 << k) - 1) for k in range(40)]  # neighbours differ in a bit, all in one list or another
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, f0 long"))
    assert {x["component_id"] for x in got.collect()} == {0}


def test_small_table_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash.op3_simhash(spark, SMALL), *COLUMNS) == brute(rows)


def test_empty_table(documents):
    assert simhash.near_groups(documents([])).count() == 0


def test_every_five_positions_hold_one_listed_set():
    assert len(simhash.QUADRUPLES) == 14
    for five in combinations(range(8), 5):
        assert sum(set(four) <= set(five) for four in simhash.QUADRUPLES) == 1


def test_the_tally_decides():
    """Pairs that meet in a list share four bytes; those without a fifth go by the tally, those with five by their bits."""
    a = np.array([0] * 4, np.uint64)
    far = np.array([0x01010101_00000000, 0x00010101_00000000, 0x00000307_00000000, 0x00000001_00000000], np.uint64)
    assert simhash._linked(a, far).tolist() == [False, True, False, True]


def test_near_copies_go_and_clean_documents_stay(documents):
    r = random.Random(5)
    rows, copies = [], set()
    for i in range(120):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(150, 600))]
        rows.append((10 * i + 5, " ".join(words)))
        for k in range(r.randrange(3)):
            near = list(words)
            for _ in range(max(1, len(words) // 150)):
                near[r.randrange(len(near))] = "edit"
            rows.append((10 * i + 6 + k, " ".join(near)))
            copies.add(10 * i + 6 + k)
    rows += [(None, rows[0][1]), (9000, None), (9001, ""), (9002, " ")]
    df = documents(rows, clash=True)
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    kept = {x["doc_id"] for x in out.select("doc_id").collect()}
    assert {i for i, _ in rows} - copies <= kept
    assert len(kept & copies) <= 0.02 * len(copies)
    assert simhash.drop_near_copies(documents([])).count() == 0


def five_words(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_drops(rows):
    """Ids that exact similarities of 0.8 or more drop, by all pairs."""
    sets, root = [five_words(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 9 * both >= 4 * (len(sets[a]) + len(sets[b])) > 0:
            x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
            root[y] = x
    return {rows[k][0] for k in range(len(rows)) if rows[find(k)][0] != rows[k][0]}


def test_near_copies_are_judged_by_exact_similarity(documents):
    """Pairs around 0.8, short and long: none at 0.8 or more is missed, none below is dropped."""
    r = random.Random(11)
    rows = []
    for i in range(400):
        size = r.choice([9, 13, 14, 40, 100, 300, 900])
        words = [f"w{r.randrange(100_000)}" for _ in range(size)]
        rows.append((2 * i, " ".join(words)))
        near, n = list(words), size - 4
        kept = int(n * r.uniform(0.8, 0.97))  # shingles left when the end is another
        near[kept + 4 :] = [f"x{r.randrange(100_000)}" for _ in range(n - kept)]
        rows.append((2 * i + 1, " ".join(near)))
    want = brute_drops(rows)
    assert 50 < len(want) < 350
    kept = {x["doc_id"] for x in simhash.drop_near_copies(documents(rows)).select("doc_id").collect()}
    assert {i for i, _ in rows} - kept == want


def test_long_lists_lose_no_pair():
    """Whatever links the first pairs of a long list give, the rest of its pairs follow."""
    rows = {"token": np.repeat([1, 2], [40, 5]), "node": np.arange(45), "n": np.full(45, 100, np.int32), "pos": np.zeros(45, np.int32)}
    out = shingle_join.first_pairs(pa.table(rows))
    pairs = {(u, v) for u, v in zip(out["u"].to_pylist(), out["v"].to_pylist()) if v is not None}
    lists = out.filter(pa.compute.is_null(out["v"]))
    assert lists.num_rows == 40 and {p for p in pairs if p[0] >= 40} == set(combinations(range(40, 45), 2))
    for roots in (np.arange(45), np.arange(45) % 3, np.zeros(45, int)):
        more = shingle_join.other_pairs(lists.append_column("root", pa.array(roots[lists["u"].to_numpy()])))
        assert set(zip(more["u"].to_pylist(), more["v"].to_pylist())) == {(a, b) for a, b in combinations(range(40), 2) if roots[a] != roots[b]}


def test_near_copies_in_long_lists_against_all_pairs(documents):
    r = random.Random(7)
    line = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(line[:116] + [f"{i}x{k}" for k in range(r.randrange(4, 60))])) for i in range(70)]
    want = brute_drops(rows)
    kept = {x["doc_id"] for x in simhash.drop_near_copies(documents(rows)).select("doc_id").collect()}
    assert 0 < len(want) < 70 and {i for i, _ in rows} - kept == want


def test_screening_keeps_every_pair_that_has_the_similarity():
    """The tally of the common prefix against the exact similarity, with shingles of different frequency classes."""
    rng = np.random.default_rng(11)
    weight = np.zeros(1 << shingle_join.BUCKET_BITS, np.int64)
    weight[rng.integers(0, len(weight), len(weight) // 3)] = 7
    dropped = 0
    for _ in range(800):
        shared = rng.integers(0, 1 << 63, int(rng.integers(1, 200))).astype(np.uint64) * np.uint64(2)
        own = [rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(shared) // 2))).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        sets = [np.unique(np.concatenate([shared, x])) for x in own]
        prefix = []
        for s in sets:
            order = np.lexsort((s, weight[(s >> np.uint64(64 - shingle_join.BUCKET_BITS)).astype(np.int64)]))
            prefix.append(s[order[: len(s) - -(-4 * len(s) // 5) + 1]])
        both = len(np.intersect1d(*sets))
        near = 5 * both >= 4 * (len(sets[0]) + len(sets[1]) - both)
        kept = shingle_join.can_reach(prefix[0], len(sets[0]), prefix[1], len(sets[1]), weight)
        assert kept or not near
        dropped += not kept
    assert dropped > 100


def test_recall_of_near_copies_on_the_tables(spark):
    """All pairs of different texts at similarity 0.8 or more: one of each such pair goes, and nothing else does."""
    rows = {x["doc_id"]: x["text"] or "" for x in table(spark, SMALL, "documents").collect()}
    sets = {}
    for i, t in rows.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    links = [(i, j) for i in rows for j in rows if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = {i: i for i in rows}
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    kept = {x["doc_id"] for x in simhash.drop_near_copies(table(spark, SMALL, "documents")).collect()}
    assert links and kept == {i for i in rows if root[i] == i}


def test_rows_with_partners():
    """A row stays if some row of another root in its list passes the bound on sizes and positions, else it goes."""
    rng = np.random.default_rng(3)
    rows = {"token": np.sort(rng.integers(0, 6, 200)), "u": np.arange(200), "n": rng.integers(20, 60, 200).astype(np.int32), "pos": rng.integers(0, 8, 200).astype(np.int32), "root": rng.integers(0, 5, 200)}
    t, n, pos, root = (rows[c].tolist() for c in ("token", "n", "pos", "root"))
    want = {i for i in range(200) if any(t[i] == t[j] and root[i] != root[j] and 9 * min(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j]) for j in range(200))}
    assert set(shingle_join.partnered(pa.table(rows))["u"].to_pylist()) == want and 0 < len(want) < 200


def close(x):
    return x.bit_count() <= 10 and sum(x >> 8 * k & 255 == 0 for k in range(8)) >= 3


def test_pairs_of_the_byte_index_span_all_links(spark):
    """Fingerprints some bits apart, equal ones and a group that fills long lists: the pairs are links and connect what all links do."""
    r = random.Random(17)
    prints = [f ^ sum(1 << b for b in r.sample(range(64), r.randrange(12))) for f in (r.getrandbits(64) for _ in range(120)) for _ in range(3)]
    prints += [(1 << 63) | (1 << a) | (1 << b) for a, b in combinations(range(13), 2)]

    def components(pairs):
        root = list(range(len(prints)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(prints))]

    links = {(a, b) for a, b in combinations(range(len(prints)), 2) if close(prints[a] ^ prints[b])}
    assert links >= {(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 5}
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(prints)]
    got = {tuple(x) for x in simhash.near_pairs(spark.createDataFrame(rows, "node long, f0 long")).collect()}
    assert got <= links and components(got) == components(links)


def set_bits(text):
    words = text.encode().split()
    return simhash.set_fingerprint(np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)], np.uint64)))


def close_texts(a, b):
    return close((set_bits(a) ^ set_bits(b)) & ((1 << 64) - 1))


def test_fingerprints_of_sets():
    r = random.Random(23)
    words = [f"w{r.randrange(9999)}" for _ in range(20_000)]
    assert set_bits(" ".join(words)) == int(np.uint64(simhash.simhash(" ".join(words).encode(), 5)).view(np.int64))


def test_near_copies_of_close_fingerprints_are_linked_by_simhash(documents, monkeypatch):
    """What fingerprints link needs no list of shingles; the rest goes there, and exact similarities decide on both."""
    r = random.Random(19)
    rows, linked, met = [], 0, []
    for i in range(60):
        words = [f"w{r.randrange(100_000)}" for _ in range(900)]
        tail = r.choice([2, 30, 80])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-tail], *(f"x{r.randrange(100_000)}" for _ in range(tail))]))]
        linked += close_texts(rows[-2][1], rows[-1][1])
    words = [f"w{r.randrange(100_000)}" for _ in range(400)]
    while True:  # close fingerprints, but not 0.8
        far = " ".join([*words[:-53], *(f"x{r.randrange(100_000)}" for _ in range(53))])
        if close_texts(" ".join(words), far):
            break
    rows += [(900, " ".join(words)), (901, far)]
    screened = shingle_join.screened
    monkeypatch.setattr(shingle_join, "screened", lambda pairs, *rest: (met.append(pairs.count()), screened(pairs, *rest))[1])
    kept = {x["doc_id"] for x in simhash.drop_near_copies(documents(rows)).select("doc_id").collect()}
    want = brute_drops(rows)
    assert len(want) == 60 and {i for i, _ in rows} - kept == want
    assert 30 < linked < 60 and met == [60 - linked + 1]
