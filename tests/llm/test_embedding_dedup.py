import numpy as np
from pyspark.sql import types as T

from quillstack.llm import embedding_dedup

from ..support import SMALL, assert_same, views
from .conftest import rows_of

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType()), T.StructField("block", T.StringType())]
)
COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def brute(rows, cosine=0.93):
    good = []
    for k, (i, v, label, *_) in enumerate(rows):
        ok = i is not None and label is not None and v and None not in v and np.all(np.isfinite(v)) and np.any(np.asarray(v) != 0)
        good.append((k, np.asarray(v, float) / np.linalg.norm(v), label) if ok else None)
    links = {k: set() for k in range(len(rows))}
    live = [g for g in good if g]
    for a, u, x in live:
        for b, v, y in live:
            if a != b and x == y and len(u) == len(v) and (u @ v >= cosine or list(rows[a][1]) == list(rows[b][1])):
                links[a].add(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min((rows[b][0] for b in seen), default=None) if i is not None else None
        out.append((i, len(links[k]), least, i == least))
    return sorted(out, key=repr)


def unit32(rng, dims):
    return [float(x) for x in rng.standard_normal(dims).astype(np.float32)]


def test_edges_against_brute_force(spark):
    v = [1.0, 0.5, 0.25]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0), (8, [1.0, None, 1.0], 0), (9, [1.0, float("nan"), 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (None, v, 0), (11, [2.0, 1.0, 0.5], 0), (12, [1.0, 0.5], 0), (12, [1.0, 0.5], 0), (13, [-1.0, -0.5, -0.25], 0), (14, [-0.0, 1.0, 0.0], 0), (15, [0.0, 1.0, 0.0], 0)]
    rows = [(*r, "x", "y") for r in rows]
    assert rows_of(embedding_dedup.embedding_groups(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == brute(rows)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            near = centre + rng.standard_normal(32) * rng.uniform(0.05, 0.45)
            rows.append((len(rows), [float(x) for x in near.astype(np.float32)], int(c % 3), None, None))
    want = brute(rows)
    assert 0 < sum(x[3] for x in want) < len(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(embedding_dedup.embedding_groups(df), *COLUMNS) == want
    assert rows_of(embedding_dedup.embedding_groups(df, chunk=3 * 32), *COLUMNS) == want  # labels dealt out in pairs of chunks


def test_links_on_both_sides_of_the_bound(spark, tmp_path):
    """The registered query against its SQL on vectors with cosines of about 0.93, as doubles and as floats, over several labels."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for cosine in rng.uniform(0.9, 0.96, 5):
            aside = rng.standard_normal(64)
            aside -= (aside @ centre) * centre
            v = cosine * centre + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)
            rows.append((len(rows), [float(x) for x in v * 10.0 ** rng.integers(-3, 4)], c % 4))
        rows.append((len(rows), [float(x) for x in centre], c % 4))
    for kind in ("double", "float"):
        folder = tmp_path / kind
        folder.mkdir()
        spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
        got = rows_of(embedding_dedup.op7_embedding_dedup(spark, str(folder)), *COLUMNS)
        assert 100 < sum(x[1] for x in got) / 2 < 300  # of 300 pairs of a centre and its neighbour
        assert_same(embedding_dedup.op7_embedding_dedup(spark, str(folder)), views(str(folder)), embedding_dedup.OP7_SQL)


def test_doubles_are_compared_as_doubles(spark):
    """A pair that rounding to floats would bring over the bound, and vectors whose squares no double holds."""
    c = 0.93 - 1e-10
    rows = [(1, [1.0, 0.0], 0), (2, [c, float(np.sqrt(1 - c * c))], 0), (3, [1e200, 0.0], 1), (4, [1e-200, 1e-202], 1), (5, [1.0, 0.0], 2), (6, [0.93 + 1e-10, float(np.sqrt(1 - (0.93 + 1e-10) ** 2))], 2)]
    got = rows_of(embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id", "n_links")
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_blocks_spare_verification():
    """Vectors without structure: what the blocks let through beyond links is a small share of all pairs."""
    vectors = np.random.default_rng(9).standard_normal((2000, 64))
    u, _, verified = embedding_dedup.near_pairs(vectors, np.zeros(2000), True, 0.93)
    assert not len(u) and verified < 2000 * 1999 / 2 / 1000


def test_empty_table(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    assert_same(embedding_dedup.op7_embedding_dedup(spark, SMALL), views(SMALL), embedding_dedup.OP7_SQL)
