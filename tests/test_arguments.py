import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstack.plans import arguments as a
from quillstack.plans import templates as t


def sections(*args):
    return a.compile_sections(a.parse(list(args)).ops)


def test_options_values_and_clusters():
    p = a.parse(["-lHm1k", "x", "--head=3", "--tail", "2", "-vv", "--verbose=debug", "-o", "out.md", "--", "-y", "--xml"])
    assert [(o.name, o.value) for o in p.ops] == [("line-numbers", "true"), ("hidden", "true"), ("max-size", "1k"), ("file", "x"), ("head", "3"), ("tail", "2"), ("verbose", "true"), ("verbose", "true"), ("verbose", "debug"), ("output", "out.md"), ("file", "-y"), ("file", "--xml")]
    assert p.settings == {"verbose": "debug", "output": "out.md"}


@pytest.mark.parametrize("args", [["--nope"], ["-X"], ["--head"], ["--head", "x"], ["-m", "0"], ["-m", "1.5k"], ["-i", "a[b"], ["-e", "{a"], ["--xml=1"], ["-n"]])
def test_errors(args):
    with pytest.raises(a.ArgumentError):
        a.parse(args)


def test_options_open_sections_and_scope():
    got, warnings = sections("-n", "3", "a", "b", "-l", "c", "-s", "T", "d")
    assert [([i.value for i in s.items], s.render.head, s.render.tail, s.render.numbers) for s in got] == [(["a", "b"], 2, 1, False), (["c"], -1, 0, True), (["T", "d"], -1, 0, False)]
    assert not warnings
    got, _ = sections("--head", "3", "--tail", "2", "a")
    assert (got[0].render.head, got[0].render.tail) == (0, 2)
    got, _ = sections("-l", "-s", "T", "a")  # options before any file carry on
    assert got[0].render.numbers and [i.kind for i in got[0].items] == ["section", "file"]


def test_trailing_options_go_back():
    got, warnings = sections("a", "-l")
    assert got[0].render.numbers and "trailing" in warnings[0]
    got, warnings = sections("a", "-l", "-s", "T", "b")
    assert [s.render.numbers for s in got] == [True, False] and len(warnings) == 1
    assert "no files" in sections("-l")[1][0]


def test_negative_numbers_of_lines():
    assert [(s.render.head, s.render.tail) for s in (sections("-n", n, "a")[0][0] for n in ("-1", "0", "1", "5"))] == [(0, 0), (0, 0), (1, 0), (3, 2)]


def test_trees_cover_their_group():
    [s], _ = sections("a", "-T", "b", "-t", "c")
    assert [(i.kind, i.tree_only, i.covers) for i in s.items] == [("file", False, ()), ("tree", False, (0, 2)), ("file", False, ()), ("tree", True, (4,)), ("file", True, ())]
    assert sections("-T")[1] == ["a tree covers no files"]


def test_globs_keep_their_order():
    [s], _ = sections("-i", "*.go", "-e", "x/", "-i", "!y", ".")
    assert [(r.pattern, r.keep, r.whitelist) for r in s.options.globs] == [("*.go", True, True), ("x/", False, False), ("y", False, False)]


@given(st.lists(st.sampled_from(["-l", "-n3", "a", "b", "-s", "T", "-t", "-T", "-H", "-", "-p", "x", "--head=1"]), max_size=12))
def test_every_input_lands_in_one_section(args):
    try:
        ops = a.parse(args).ops
    except a.ArgumentError:
        return
    got, _ = a.compile_sections(ops)
    assert [i.kind for s in got for i in s.items] == [a.item_of(o).kind for o in ops if o.kind == a.ACTION]


@pytest.mark.parametrize(
    "source, context, want",
    [
        ("a{{ .X }}b", {"X": 1}, "a1b"),
        ("{{ if gt .N 1 }}many{{ else if eq .N 1 }}one{{ else }}none{{ end }}", {"N": 1}, "one"),
        ("x {{- .X -}} y", {"X": "-"}, "x-y"),
        ('{{ $s := "" }}{{ if .A }}A{{ $s = ", " }}{{ end }}{{ if .B }}{{ $s }}B{{ end }}', {"A": 1, "B": 1}, "A, B"),
        ('{{ .N | printf "%05d" }} {{ printf "%s-%v" "a" .N }}', {"N": 42}, "00042 a-42"),
        ("{{ .T | escape | endNewline }}", {"T": "<&'\">"}, "&lt;&amp;&#39;&#34;&gt;\n"),
        ("{{ humanize .N }} {{ commafy .N }} {{ plural .N `row` `rows` }}", {"N": 1250000}, "1.2 MB 1,250,000 rows"),
        ("{{ range .L }}<{{ . }}>{{ else }}empty{{ end }}", {"L": ["a", "b"]}, "<a><b>"),
        ("{{ with .M }}{{ .K }}{{ end }}", {"M": {"K": "v"}}, "v"),
        ("{{/* note */}}{{ if and .A (not .B) }}yes{{ end }}", {"A": True, "B": False}, "yes"),
        ('{{ template "p" . }}!', {"X": 7}, "<7>!"),
    ],
)
def test_templates(source, context, want):
    assert t.Template(source, None, {"p": "<{{ .X }}>"})(context) == want


@pytest.mark.parametrize("source", ["{{ .Nope }}", "{{ if .Path }}", "{{ end }}", "{{ nofunc .Path }}", "{{ .Path", "{{ .Section.Nope }}", "{{ (.Path }}", "{{ }}"])
def test_template_errors_come_before_rendering(source):
    with pytest.raises(t.TemplateError):
        t.compile_templates({"file_content_template": source})


def test_partials_and_other_dots_are_known():
    made = t.compile_templates({"file_compact_template": '{{ template "file_header" . }}{{ with .Section }}:{{ .Index }}{{ end }}'})
    assert made["file_compact"]({"Path": "p", "SectionFileIndex": 2, "Section": {"TotalFiles": 3, "Index": 1}}) == "[2/3] p:1"


def test_dates_and_sizes():
    from datetime import datetime

    assert t.go_date("2006-01-02 15:04:05", datetime(2024, 3, 5, 7, 8, 9)) == "2024-03-05 07:08:09"
    assert [t.humanize(n) for n in (0, 999, 1000, 1250, 999_999, 10**15)] == ["0 B", "999 B", "1.0 kB", "1.2 kB", "1000.0 kB", "1.0 TB"]
    assert [a.size_of(x) for x in ("4096", "512k", "2MB", " 1g ")] == [4096, 512_000, 2_000_000, 10**9]
