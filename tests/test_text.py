import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import names, text
from quillstack.operators import globs


def scan(data: bytes) -> int:
    """Tokens of bytes by a plain automaton."""
    words = chars = blanks = breaks = high = symbols = 0
    before = ""
    for b in data:
        c = chr(b)
        kind = "w" if c.isascii() and (c.isalnum() or c == "_") else "s" if c in " \t\r\x0b\f" else "n" if c == "\n" else "h" if b >= 128 else "y"
        words += kind == "w" and before != "w"
        chars += kind == "w"
        blanks += kind == "s" and before != "s"
        breaks += kind == "n"
        high += kind == "h"
        symbols += kind == "y"
        before = kind
    return (100 * words + max(0, chars - 4 * words) * 100 // 4 + 55 * symbols + 30 * blanks + 100 * breaks + 50 * high) // 100


def estimate(data: bytes) -> int:
    if len(data) <= text.SAMPLE_ABOVE:
        return scan(data)
    return (scan(data[: text.SAMPLE_HEAD]) + scan(data[-text.SAMPLE_TAIL :])) * len(data) // (text.SAMPLE_HEAD + text.SAMPLE_TAIL)


def test_token_estimate_against_an_automaton(spark):
    r = random.Random(1)
    pieces = [b"word", b" ", b"  ", b"\n", "é€😀".encode(), b"a_b9", b"{}();", b"\t\r", b"\xff\xc3", b"w"]
    rows = [b"".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(200)]
    rows += [b"".join(r.choice(pieces) for _ in range(200_000)), b"x" * text.SAMPLE_ABOVE, b"x " * (text.SAMPLE_ABOVE // 2) + b"y", b""]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(rows)], "i int, d binary")
    got = {x["i"]: x["t"] for x in df.select("i", text.token_estimate(F.col("d")).alias("t")).collect()}
    assert got == {i: estimate(d) for i, d in enumerate(rows)}


@pytest.mark.parametrize("data, want", [(b"", False), (b"plain", False), ("ä€😀".encode(), False), (b"a\0b", True), (b"\xff", True), (b"ab\xc3\x28", True), (b"x" * 1023 + "é".encode(), False), (b"x" * 1022 + "€".encode(), False), (b"x" * 1024 + b"\0\xff", False), (b"\xe2\x82", False)])
def test_binary_content(spark, data, want):
    from quillstack.functions.media import looks_binary

    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    assert df.select(text.is_binary(F.col("d"))).first()[0] is want
    assert looks_binary(data) is want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["*", "**", "?", "a", "b", "/", "[ab]", "{a,b}", ".x", "c*"]), max_size=6).map("".join), st.lists(st.sampled_from(["a", "b", "ab", ".x", "c1"]), min_size=1, max_size=4).map("/".join))
def test_globs_against_a_plain_matcher(glob, path):
    def match(g: str, p: str) -> bool:
        if not g:
            return not p
        if g.startswith("**"):
            stars = len(g) - len(g.lstrip("*"))
            return match("*" + g[stars:], p)
        if g[0] == "*":
            return any(match(g[1:], p[k:]) for k in range(len(p) + 1) if "/" not in p[:k])
        if g[0] == "?":
            return bool(p) and p[0] != "/" and match(g[1:], p[1:])
        if g[0] == "[":
            return bool(p) and p[0] in g[1 : g.index("]")] and match(g[g.index("]") + 1 :], p[1:])
        if g[0] == "{":
            return any(match(x + g[g.index("}") + 1 :], p) for x in g[1 : g.index("}")].split(","))
        return bool(p) and p[0] == g[0] and match(g[1:], p[1:])

    if any(part.startswith("**") and part.strip("*") == "" and len(part) > 1 for part in glob.replace("{", "/").replace("}", "/").replace(",", "/").split("/")):
        return  # whole ** segments have a meaning of their own
    import re

    assert bool(re.match(globs.glob_regex(glob), path)) == match(glob, path)


@pytest.mark.parametrize("glob, path, want", [("a/**", "a", True), ("a/**", "a/b/c", True), ("**/c", "c", True), ("**/c", "a/b/c", True), ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("a/**/c", "ac", False), ("**", "a/b", True), ("[!a]x", "bx", True), ("[!a]x", "/x", False), ("a\\*", "a*", True), ("{a/b,c}/d", "a/b/d", True)])
def test_double_stars_and_escapes(glob, path, want):
    import re

    assert bool(re.match(globs.glob_regex(glob), path)) is want


@pytest.mark.parametrize("glob", ["[a", "{a", "a}", "a\\"])
def test_broken_globs(glob):
    with pytest.raises(globs.GlobError):
        globs.glob_regex(glob)


def test_ignore_lines():
    rules = globs.parse_ignore("# c\n\n *.log\r\n!keep\n\\!bang\n\\#hash\nlib/\ntrail  \nkept\\ \na//b/../c\ndeep/**\n")
    assert [(r.pattern, r.keep) for r in rules] == [("*.log", False), ("keep", True), ("!bang", False), ("#hash", False), ("lib/", False), ("trail", False), ("kept ", False), ("a/c", False), ("deep/**", False)]
    assert not rules[-1].matches("deep", True) and rules[-1].matches("deep/x", False)
    assert rules[4].matches("x/lib", True) and not rules[4].matches("x/lib", False)


def test_columns_judge_like_single_rules(spark):
    rules = [globs.exclude("*.a"), globs.include("x/*.b"), globs.exclude("/top"), globs.exclude("!y/**")]
    paths = ["p.a", "x/q.b", "x/z/q.b", "top", "s/top", "y/p.a", "x/.h", "m"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["v"] for r in df.select("path", globs.verdict(F.col("path"), F.lit(False), rules).alias("v")).collect()}
    for p in paths:
        hits = [r for r in rules if r.matches(p, False)]
        assert got[p] == (None if not hits else "keep" if hits[-1].keep else "ignore")


def test_language_of_one_file_equals_the_column(spark):
    rows = [("a/Main.GO", ""), ("Dockerfile.dev", ""), ("run", "#!/usr/bin/env python3\nx"), ("run2", "#!/bin/sh"), ("x.unknown", "plain"), (".bashrc", ""), ("noext", ""), ("Makefile", "")]
    df = spark.createDataFrame(rows, "path string, t string")
    got = {r["path"]: r["l"] for r in df.select("path", names.detect_language(F.col("path"), F.col("t")).alias("l")).collect()}
    assert got == {p: names.language_of(p, t) for p, t in rows}
