import hashlib
import random
import re
from collections import defaultdict

from quillstack.llm import exact_dedup

from ..support import SMALL, assert_same, views
from .conftest import rows_of


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids, default=None)
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_edges_against_brute_force(documents):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (6, " "), (None, "a b"), (None, None), (7, "x" * 300_000), (7, "x" * 300_000), (8, "A b")]
    assert rows_of(exact_dedup.exact_groups(documents(rows, clash=True)), *COLUMNS) == brute(rows)


def test_heavy_groups_against_brute_force(documents):
    r = random.Random(1)
    rows = [(i, r.choice(["hot one", "hot  one", "hot two"]) if r.random() < 0.7 else f"text {r.randrange(400)}") for i in range(2000)]
    assert rows_of(exact_dedup.exact_groups(documents(rows), support=0.05), *COLUMNS) == brute(rows)


def test_empty_table(documents):
    assert exact_dedup.exact_groups(documents([])).count() == 0


def test_drop_keeps_columns_and_smallest_ids(documents):
    rows = [(5, "a  b"), (3, "a b"), (None, "a b"), (8, "c")]
    df = documents(rows, clash=True)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    assert rows_of(out, "doc_id", "text") == sorted([(3, "a b"), (None, "a b"), (8, "c")], key=repr)


def test_query_equals_sql(spark):
    assert_same(exact_dedup.op2_exact_dedup(spark, SMALL), views(SMALL), exact_dedup.OP2_SQL)
