import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import dedup, globs, ranges, sections, slicing, tree
from quillstack.operators.lineage import numbered
from quillstack.plans.bundle import tree_text


@pytest.mark.parametrize(
    "paths, want",
    [
        (["a.txt"], "a.txt\n"),
        (["main.go", "src/app.go", "src/sub/h.go", "lib/x", "README.md"], "├── lib/\n│   └── x\n├── src/\n│   ├── sub/\n│   │   └── h.go\n│   └── app.go\n├── README.md\n└── main.go\n"),
        (["r/a/b", "r/c"], "r/\n├── a/\n│   └── b\n└── c\n"),
        (["x", "x/y"], "x/\n└── y\n"),
        (["./p//q", " p/r "], "p/\n├── q\n└── r\n"),
        (["https://h.org/d/f?q=1", "http://h.org"], "├── https://h.org/\n│   └── d/\n│       └── f?q=1\n└── http://h.org\n"),
    ],
)
def test_trees(spark, paths, want):
    assert tree_text(spark, paths) == want


def test_numbering_is_total_and_independent_of_partitions(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i) for i in range(500)]
    want = {i: k + 1 for k, (_, i) in enumerate(sorted(rows))}
    for parts in (1, 7):
        got = numbered(spark.createDataFrame(rows, "a int, i int").repartition(parts), [F.col("a"), F.col("i")], "n")
        assert {x["i"]: x["n"] for x in got.collect()} == want


@pytest.mark.parametrize("kinds", [["section", "file", "file", "section", "file"], ["file", "section", "file"], ["prompt", "file"], ["section", "section", "file", "prompt", "file"]])
def test_sections_and_indices(spark, kinds):
    items = spark.createDataFrame(list(enumerate(kinds)), "p int, kind string")
    got = sections.with_file_index(sections.with_sections(items, [F.col("p")])).orderBy("item_seq").collect()
    explicit, now, n, per = kinds[0] == "section", -1 if kinds[0] == "section" else 0, 0, {}
    for k, row in zip(kinds, got):
        now += k == "section"
        assert (row["kind"], row["section"], row["is_implicit"]) == (k, now, not explicit and now == 0)
        if k == "file":
            n += 1
            per[now] = per.get(now, 0) + 1
            assert (row["file_index"], row["section_file_index"]) == (n, per[now])
    assert all(row["section_files"] == per[row["section"]] for row in got if row["kind"] == "file")


def test_merge_ranges_against_a_loop(spark):
    r = random.Random(2)
    rows = [(k % 5, a := r.randrange(60), a + r.randrange(0, 5)) for k in range(120)]
    want = set()
    for key in range(5):
        out = []
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a < b):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want |= {(key, a, b) for a, b in out}
    got = ranges.merge_ranges(spark.createDataFrame(rows, "k int, start int, end int"), "k")
    assert {tuple(x) for x in got.select("k", "start", "end").collect()} == want


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\nb\n", "\n\n", "a\n\nb\nc\nd\ne\n", "x\r\ny\r\nz"])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 100])
def test_slices(spark, text, n):
    lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
    ended = lambda part: "".join(x + "\n" for x in part)
    row = spark.createDataFrame([(text,)], "t string").select(slicing.excerpt(F.col("t"), n).alias("head"), slicing.excerpt(F.col("t"), 0, n).alias("tail"), slicing.lines_option(F.col("t"), n).alias("both")).first()
    whole = ended(lines)
    assert row["head"] == (whole if n >= len(lines) else ended(lines[:n]))
    tail = ended(lines[len(lines) - n :])
    assert row["tail"] == (whole if n >= len(lines) else tail if text.endswith("\n") else tail.removesuffix("\n"))
    if n >= len(lines):
        assert row["both"] == whole
    elif n > 1:
        top, bottom = lines[: (n + 1) // 2], ended(lines[len(lines) - n // 2 :])
        assert row["both"] == ended(top) + f"... ({len(lines) - n} rows skipped)\n" + (bottom if text.endswith("\n") else bottom.removesuffix("\n"))


def test_first_of_and_shallowest(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 5, "n"), (None, 4, "m")], "k string, seq int, v string")
    assert {tuple(r) for r in dedup.first_by_key(rows, ["k"], "seq").collect()} == {("a", 1, "y"), ("b", 2, "z"), (None, 4, "m")}
    named = spark.createDataFrame([("n", "d/n.md"), ("n", "e/n.md"), ("n", "d/e/n.md"), ("m", "m.md")], "name string, path string")
    assert {tuple(r) for r in dedup.shallowest(named).collect()} == {("n", "d/n.md", 2), ("n", "e/n.md", 2), ("m", "m.md", 1)}


@pytest.mark.parametrize(
    "glob, folder, reached",
    [
        ("{**,a}/x.go", "a", True), ("{**,a}/x.go", "a/b", True), ("{a,b}/c/x", "b", True), ("{a,b}/c/x", "b/c", True), ("{a,b}/c/x", "c", False), ("{a,b/c}/x", "b", True), ("{a,b/c}/x", "b/d", False),
        ("a/{b,{c,**}}/d", "a/z/y", True), ("[{]/x", "{", True), ("[{]/x", "a", False), ("\\{a/b", "{a", True), ("a/b", "a/b", False), ("*.py", "any/where", True),
    ],
)
def test_which_directories_a_glob_reaches(glob, folder, reached):
    assert globs.Rule(glob, True).reaches(folder) is reached


def test_alternatives_of_braces():
    assert sorted(globs.alternatives("a{b,c{d,e}}f")) == ["abf", "acdf", "acef"]
    assert globs.alternatives("plain/[{]*") == ["plain/[{]*"] and globs.alternatives("{a,b") is None and globs.alternatives("{a,b}" * 9) is None
