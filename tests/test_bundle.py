import gzip
import os
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from quillstack.plans import bundle as plans
from quillstack.plans.bundle import Bundle, Render, items_of_files, render_items, sliced, stats_text
from quillstack.plans.templates import TemplateError
from quillstack.sources.walk import Options, walk_files

from .test_media import png
from .test_sources import tree, zipped


@pytest.fixture
def project(tmp_path):
    return tree(tmp_path / "p", {"a.py": "def f():\n    return 1\n", "b.txt": "one\ntwo\nthree\nfour\nfive\nsix\n", "empty.txt": "", "data.bin": b"\0\1\2", "pic.png": png(), "page.html": "<h1>T</h1><p>x</p>", "arch/z.zip": zipped({"in.md": b"# in"})})


def text(spark, project, *args, **options):
    return Bundle.from_arguments(spark, list(args), cwd=str(project), **options).text()


def test_markdown(spark, project):
    assert text(spark, project, "a.py") == "a.py (2 rows)\n---\n```python\ndef f():\n    return 1\n```\n\n"
    assert text(spark, project, "a.py", "empty.txt", "data.bin") == (
        "[1/3] a.py (2 rows)\n---\n```python\ndef f():\n    return 1\n```\n\n[2/3] empty.txt (0 rows)\n[3/3] data.bin - binary file skipped (3 B)\n\n"
    )


def test_slices_numbers_and_compact(spark, project):
    assert text(spark, project, "-n", "3", "-l", "b.txt") == "b.txt (6 rows)\n---\n```text\n1: one\n2: two\n... (3 rows skipped)\n6: six\n```\n\n"
    assert text(spark, project, "-n", "0", "a.py", "b.txt") == "[1/2] a.py (2 rows)\n[2/2] b.txt (6 rows)\n\n"
    assert text(spark, project, "--tail", "1", "b.txt") == "b.txt (6 rows)\n---\n```text\nsix\n```\n\n"


def test_sections_prompts_and_trees(spark, project):
    got = text(spark, project, "-p", "Look:", "-s", "Code", "-T", "a.py", "-s", "Text", "-n0", "b.txt")
    assert got == (
        "Look:\n\n\n## Code\n---\n\n```\na.py\n```\n\na.py (2 rows)\n---\n```python\ndef f():\n    return 1\n```\n\n## Text\n---\n\nb.txt (6 rows)\n\n"
    )
    assert text(spark, project, "-t", "arch", "a.py") == "```\n├── arch/\n│   └── z.zip\n└── a.py\n```\n\n"


def test_conversions(spark, project):
    assert text(spark, project, "-D", "page.html") == "page.html (3 rows)\n---\n```markdown\n# T\n\nx\n```\n\n"
    assert text(spark, project, "-M", "pic.png") == "pic.png (2 rows)\n---\n```\nContainer: png\nImage: 32x16, rgb, 8-bit\n```\n\n"
    assert text(spark, project, "-Z", "arch") == "arch/z.zip/in.md (1 rows)\n---\n```markdown\n# in\n```\n\n"
    assert text(spark, project, "-u", "a.py") == "a.py (2 rows, function signatures)\n---\n```python\ndef f():\n```\n\n"


def test_other_profiles(spark, project):
    assert text(spark, project, "--bare", "b.txt", "data.bin") == "one\ntwo\nthree\nfour\nfive\nsix\n"
    got = text(spark, project, "--xml", "-s", "S", "a.py", "data.bin")
    assert got == (
        '<section>\n  <section_name>S</section_name>\n\n  <document index="1" language="python" rows="2">\n    <source>a.py</source>\n    <document_content>\ndef f():\n    return 1\n    </document_content>\n  </document>\n\n'
        '  <document index="2">\n    <source>data.bin</source>\n    <error>Binary file (3 B)</error>\n  </document>\n</section>\n\n'
    )
    got = text(spark, project, "--html", "pic.png", "a.py")
    assert 'src="data:image/png;base64,iVBOR' in got and "def f():" in got and got.startswith("<!DOCTYPE html>") and "Files: 2" in got


def test_walk_by_default_piped_lists_and_standard_input(spark, project):
    every = Bundle.from_arguments(spark, [], cwd=str(project))
    assert [r["path"] for r in every.rows] == ["a.py", "arch/z.zip", "b.txt", "data.bin", "empty.txt", "page.html", "pic.png"]
    piped = Bundle.from_arguments(spark, ["-e", "*.bin"], cwd=str(project), stdin=b"b.txt\n./b.txt\ndata.bin\n")
    assert [r["path"] for r in piped.rows] == ["b.txt"]
    assert text(spark, project, "-", stdin=b"from outside") == "stdin (1 rows)\n---\n```\nfrom outside\n```\n\n"
    assert [r["kind"] for r in Bundle.from_arguments(spark, ["-p", "only"], cwd=str(project)).rows] == ["prompt"]


def test_sizes_failures_and_report(spark, project, tmp_path):
    bundle = Bundle.from_arguments(spark, ["-m", "20", "a.py", "b.txt", "missing", "data.bin", "-o", str(tmp_path / "out.md")], cwd=str(project))
    report = bundle.write()
    assert (report["TotalFiles"], report["SkippedBySize"], report["FailedFiles"], report["BinaryFiles"], report["TotalRows"]) == (1, 2, 1, 1, 0)
    assert (tmp_path / "out.md").read_text() == "data.bin - binary file skipped (3 B)\n\n"
    assert [(r["path"], r["failure"]) for r in bundle.failures().collect()] == [("missing", "stat: no such file or directory")]
    shown = stats_text(report)
    assert shown.startswith("▎ 1 file · 0 rows · 1 section · 3 B\n  ~") and shown.endswith("  2 skipped (size) · 1 binary · 1 failed\n")
    assert bundle.plan().first().asDict() == {"total_files": 1, "total_size": 3, "size_unknown": False, "token_estimate": 0}


def test_an_unreadable_file_is_shown_and_counted(spark, project):
    bundle = Bundle.from_arguments(spark, ["a.py"], cwd=str(project))
    os.unlink(project / "a.py")
    assert bundle.text() == "a.py - error: no such file or directory\n\n"
    assert bundle.failures().count() == 1


def test_the_old_output_stays_if_a_run_fails(spark, project, tmp_path):
    out = tmp_path / "out.md"
    out.write_text("old")
    bundle = Bundle.from_arguments(spark, ["a.py", "-o", str(out)], cwd=str(project), config={"file_content_template": "{{ index .Path 999 }}"})
    with pytest.raises(Exception):
        bundle.write()
    assert out.read_text() == "old" and os.listdir(tmp_path) == ["p", "out.md"] or out.read_text() == "old"


def test_own_templates(spark, project):
    config = {"file_content_template": "<{{ .Path }}|{{ .TotalRows }}|{{ .FileIndex }}/{{ .Global.TotalFiles }}>", "separators": False, "output_footer_template": "!"}
    assert text(spark, project, "a.py", "b.txt", config=config) == "<a.py|2|1/2><b.txt|6|2/2>!"
    with pytest.raises(TemplateError):
        text(spark, project, "a.py", config={"file_content_template": "{{ .Nope }}"})


def test_parts_hold_the_items_in_order(spark, project, tmp_path):
    Bundle.from_arguments(spark, ["-n0", "a.py", "b.txt", "page.html"], cwd=str(project)).write_parts(str(tmp_path / "parts"))
    names = sorted(n for n in os.listdir(tmp_path / "parts") if n.startswith("part-"))
    assert "".join((tmp_path / "parts" / n).read_text() for n in names).split("\n")[0].startswith("[1/3] a.py")


def test_a_walked_table_renders_like_its_list(spark, project):
    files = walk_files(spark, ".", Options(), str(project))
    table = render_items(items_of_files(files, Render(head=1, tail=0))).orderBy("position").collect()
    listed = Bundle.from_arguments(spark, ["--head", "1"], cwd=str(project)).rendered().orderBy("position").collect()
    assert [r["item"] for r in table] == [r["item"] for r in listed]
    small = items_of_files(files, Render(max_size=3)).orderBy("position").collect()
    assert [r["path"] for r in small] == ["data.bin", "empty.txt"]


def test_written_tokens_are_summed_per_piece(spark, project):
    bundle = Bundle.from_arguments(spark, ["a.py", "b.txt"], cwd=str(project))
    assert sum(t for _, t, _ in bundle.pieces()) > 0


def test_slices_of_skeletons_count_source_rows():
    kept = [(1, "a"), (0, "..."), (5, "b"), (0, "..."), (9, "c")]
    assert sliced("x\n" * 10, Render(head=1, tail=1), kept) == "a\n... (7 rows skipped)\nc\n"
    assert sliced("x\n" * 10, Render(numbers=True), kept) == " 1: a\n...\n 5: b\n...\n 9: c\n"
    assert sliced("a\nb", Render(), None) == "a\nb\n"
    assert sliced("a\nb\nc", Render(head=0, tail=2), None) == "b\nc"


def test_templates_see_totals_and_fields(spark, project):
    config = {
        "file_content_template": "{{ .Path }} {{ .TokenEstimate }} of {{ .Global.TokenEstimate }} in {{ .Section.TotalSize }} B", "meta_template": "{{ .Fields.command }} {{ .Section.TotalFiles }}",
        "section_header_template": "<{{ .Index }}:{{ .TotalFiles }} {{ .TotalSize }}", "section_footer_template": "{{ .Index }}>", "output_header_template": "{{ .Global.TotalSections }} sections, {{ .Global.SkippedBySize }} skipped",
        "output_footer_template": "{{ .Global.TotalFiles }} in {{ .Global.TotalSections }}", "section_template": "{{ .Body }} of {{ .Global.SkippedBySize }}", "separators": False,
    }
    bundle = Bundle.from_arguments(spark, ["a.py", "-s", "S", "-m", "23", "b.txt", "a.py"], cwd=str(project), config=config)
    bundle.context(["--some", "thing"])
    got = bundle.text()
    assert bundle.skipped_by_size == 1
    assert got.startswith("2 sections, 1 skipped<0:1 22a.py ") and "0><1:1 22S of 1a.py " in got and got.endswith(" in 22 Bquillstack --some thing 11>2 in 2")
    own, planned = got.split("a.py ")[1].split(" in ")[0].split(" of ")
    assert int(own) > 0 and int(planned) == 2 * (22 // 4)


def test_own_tokenizers_count(spark, project):
    bundle = Bundle.from_arguments(spark, ["a.py"], cwd=str(project), tokenizer=F.length, size_tokenizer=lambda size: size * 10)
    assert sum(t for _, t, _ in bundle.pieces()) == len(bundle.text())
    assert bundle.plan().first()["token_estimate"] == 220


def test_archive_contents_stay_out_of_the_driver(spark, project):
    tree(project, {"arch/y.zip": zipped({"b/one.md": b"# 1", "two.txt": b"2"}), "arch/w.txt.gz": gzip.compress(b"wrapped")}, repo=False)
    bundle = Bundle.from_arguments(spark, ["-Z", "arch"], cwd=str(project))
    assert [r["path"] for r in bundle.rows] == ["arch/w.txt.gz/w.txt", "arch/y.zip/b/one.md", "arch/y.zip/two.txt", "arch/z.zip/in.md"]
    assert all(r["content"] is None and r["size"] >= 0 for r in bundle.rows)
    assert all(part in bundle.text() for part in ("wrapped", "# 1", "```text\n2", "# in"))
    os.unlink(project / "arch/y.zip")
    assert [r["path"] for r in bundle.failures().collect()] == ["arch/y.zip/b/one.md", "arch/y.zip/two.txt"]


def jobs(spark, run) -> int:
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    run()
    return scheduler.numTotalJobs() - before


def test_jobs_follow_neither_sections_nor_targets(spark, project):
    def made(n):
        return Bundle.from_arguments(spark, ["--xml", *(x for k in range(n) for x in ("-s", f"S{k}", "a.py"))], cwd=str(project))

    few, many = made(2), made(15)
    assert jobs(spark, many.text) <= jobs(spark, few.text) + 2
    piped = "\n".join(f"f{k}.txt" for k in range(40)).encode()
    assert jobs(spark, lambda: Bundle.from_arguments(spark, [], cwd=str(project), stdin=piped)) == 0


def test_rows_of_very_long_files_are_estimated(monkeypatch):
    monkeypatch.setattr(plans, "COUNTED", 100)
    monkeypatch.setattr(plans, "JUDGED", 40)
    text = "123456789\n" * 30 + "x" * 700

    def shown(**options):
        row = {"render": asdict(Render(**options)), "path": "a.txt", "abs_path": "", "content": text.encode(), "size": 1000, "media_type": None, "failure": None}
        out = plans.prepare(row, False)
        return out["rows"], out["is_estimate"], out["text"]

    assert shown(head=0, tail=0) == (100, True, "")
    assert shown(head=2, tail=1) == (100, True, "123456789\n" * 2 + "... (~97 rows skipped)\n" + "x" * 700)
    assert shown()[:2] == (31, False) and shown(head=40, tail=0)[:2] == (31, False)
    assert plans.estimated_rows(b"x" * 101) == 1 and plans.estimated_rows(b"\n" * 100) is None
