import gzip
import io
import lzma
import os
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstack.functions import names
from quillstack.operators.globs import exclude, include
from quillstack.sources import archives, inputs, walk, web
from quillstack.sources.walk import Options, Walker


def tree(root, files: dict, repo=True):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if repo:
        (root / ".git").mkdir(exist_ok=True)
        (root / ".git/HEAD").write_text("ref: x")
    return root


def found(root, shown=".", **options):
    return [e.path for e in Walker(Options(**options), shown, str(root)).walk()]


@pytest.fixture
def project(tmp_path):
    return tree(
        tmp_path / "p",
        {"README.md": "x", "main.go": "x", "a-b": "x", "a/x": "x", "a.txt": "x", ".hidden": "x", "build/keep.js": "x", "build/x.js": "x", "src/app.go": "x", "src/app_test.go": "x", "src/.env": "x", "log/app.log": "x", ".gitignore": "build/\n*.log\n", "src/.ignore": "*_test.go\n"},
    )


def test_walk_order_and_rules(project):
    assert found(project) == ["README.md", "a/x", "a-b", "a.txt", "main.go", "src/app.go"]
    assert found(project, no_ignore=True, hidden=True, globs=(exclude(".git/"),)) == [".gitignore", ".hidden", "README.md", "a/x", "a-b", "a.txt", "build/keep.js", "build/x.js", "log/app.log", "main.go", "src/.env", "src/.ignore", "src/app.go", "src/app_test.go"]


@pytest.mark.parametrize(
    "globs, want",
    [
        ([include("*.go")], ["main.go", "src/app.go", "src/app_test.go"]),
        ([include("src/*.go"), exclude("*_test.go")], ["src/app.go"]),
        ([exclude("*"), include("main.go")], ["main.go"]),
        ([exclude("src/"), exclude("a*")], ["README.md", "main.go"]),
        ([include("src/.env")], ["src/.env"]),
        ([exclude("!build/"), exclude("build/*"), include("build/keep.js")], ["build/keep.js"]),
        ([include("src")], []),
        ([include("src/**")], ["src/.env", "src/.ignore", "src/app.go", "src/app_test.go"]),
    ],
)
def test_globs(project, globs, want):
    assert found(project, globs=tuple(globs)) == want


def test_roots_are_shown_as_named(project):
    assert found(project, "./src") == ["src/app.go"]
    assert found(project.parent, "p/src", globs=(include("p/src/*.go"),)) == ["p/src/app.go", "p/src/app_test.go"]
    assert found(project / "a", "../src") == ["../src/app.go"]
    assert found(project, str(project / "src"), globs=(include("src/app.go"),)) == [str(project / "src/app.go")]
    assert found(project, "build/x.js") == ["build/x.js"]  # a named file is never filtered
    [missing] = Walker(Options(), "nothing", str(project)).walk()
    assert missing.failure.startswith("stat")


def test_git_rules_need_a_repository_and_start_over_in_a_nested_one(tmp_path):
    tree(tmp_path, {".gitignore": "*.log\n", "x.log": "", "y.txt": "", ".ignore": "*.tmp\n", "in/z.log": "", "in/a.tmp": "", "in/.gitignore": "y.txt\n", "in/y.txt": ""}, repo=False)
    assert found(tmp_path) == ["in/y.txt", "in/z.log", "x.log", "y.txt"]
    tree(tmp_path, {})
    assert found(tmp_path) == ["y.txt"]
    tree(tmp_path / "in", {})
    assert found(tmp_path) == ["in/z.log", "y.txt"]


def test_info_exclude_worktrees_and_user_rules(tmp_path):
    main = tree(tmp_path / "main", {".git/info/exclude": "secret.txt\nkeep.txt\n", ".gitignore": "!keep.txt\n", "secret.txt": "", "keep.txt": "", "o.bak": ""})
    assert found(main) == ["keep.txt", "o.bak"]
    assert found(main, ignore_rules="*.bak") == ["keep.txt"]
    assert found(main, git_excludes="*.bak") == ["keep.txt"]
    work = tree(tmp_path / "work", {".git": f"gitdir: {main}/.git/worktrees/w\n", "secret.txt": "", "n.txt": ""}, repo=False)
    tree(main, {".git/worktrees/w/commondir": "../..\n"})
    assert found(work) == ["n.txt"]


def test_links(tmp_path):
    root = tree(tmp_path / "r", {"d/f.txt": "x", "g.txt": "x"}, repo=False)
    os.symlink("d", root / "dirlink")
    os.symlink("g.txt", root / "filelink")
    os.symlink("nowhere", root / "broken")
    os.symlink("..", root / "d/loop")
    assert found(root) == ["broken", "d/f.txt", "filelink", "g.txt"]
    assert found(root, no_links=True) == ["d/f.txt", "g.txt"]
    assert found(root, follow=True) == ["broken", "d/f.txt", "dirlink/f.txt", "filelink", "g.txt"]
    assert [e.path for e in Walker(Options(), ".", str(root)).walk() if e.failure] == ["broken"]


def test_pipes_are_skipped_in_walks_and_read_to_a_cap_when_named(tmp_path):
    os.mkfifo(tmp_path / "pipe")
    assert found(tmp_path) == [] and found(tmp_path, "pipe") == ["pipe"]
    assert walk.read_stream("/dev/zero", 10) == (None, "read: stopped reading after 10 bytes (-m sets the limit)")
    assert walk.read_stream(str(tmp_path)) == (None, "read: is a directory")


def test_data_source_equals_the_walk(spark, project):
    files = walk.walk_files(spark, ".", Options(globs=(exclude("a*"),)), str(project))
    got = walk.in_walk_order(files).collect()
    assert [x["path"] for x in got] == found(project, globs=(exclude("a*"),))
    read = walk.read_content(files.where(F.col("path") == "main.go")).collect()
    assert [(x["path"], bytes(x["content"]), x["failure"]) for x in read] == [("main.go", b"x", None)]
    assert walk.walk_files(spark, "main.go", cwd=str(project)).count() == 1


def zipped(entries: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries: dict, mode="w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


FILES = {"b.txt": b"two", "a/z.go": b"one", "../out": b"no", "./a/y": b"yes", "a/y": b"again"}


@pytest.mark.parametrize("data, name", [(zipped(FILES), "x.zip"), (tarred(FILES), "x.tar"), (tarred(FILES, "w:gz"), "x.tgz"), (tarred(FILES, "w:bz2"), "x.tar.bz2"), (tarred(FILES, "w:xz"), "odd-name.zip")])
def test_archives(data, name):
    assert [(m.key, m.content) for m in archives.expand(data, name)] == [("a/y", b"yes"), ("a/z.go", b"one"), ("b.txt", b"two")]
    big = archives.expand(data, name, limit=2)
    assert all(m.content is None and m.size in (3, 3) for m in big)


def test_single_files_and_broken_archives():
    [m] = archives.expand(gzip.compress(b"text"), "d/notes.txt.gz")
    assert (m.key, m.content) == ("notes.txt", b"text")
    [m] = archives.expand(b"not an archive", "x.zip")
    assert m.failure.startswith("archive")
    [m] = archives.expand(gzip.compress(b"x" * 5000)[:-20], "x.gz")
    assert m.failure
    [m] = archives.expand(b"Rar!....", "x.rar")
    assert m.failure == "archive: no readable format"
    half = tarred({"ok": b"fine", "bad": b"y" * 3000})
    assert [(x.key, bool(x.failure)) for x in archives.expand(half[:2000], "x.tar")] in ([("ok", False), ("bad", True)], [("ok", False), ("", True)])


def test_archive_rows(spark):
    rows = spark.createDataFrame([("p/a.zip", "/p/a.zip", bytearray(zipped(FILES))), ("p/n.gz", "/p/n.gz", bytearray(gzip.compress(b"k")))], "path string, abs_path string, content binary")
    got = archives.expand_archives(rows, lambda path, is_dir: not path.endswith(".go")).collect()
    assert sorted((x["path"], bytes(x["content"])) for x in got) == [("p/a.zip/a/y", b"yes"), ("p/a.zip/b.txt", b"two"), ("p/n.gz/n", b"k")]


def test_collect_expands_archives_under_globs(project):
    tree(project, {"arch/a.zip": zipped({"src/k.go": b"k", "doc/d.md": b"d", ".h": b"h"})})
    names = lambda **o: [i.path for i in inputs.collect("arch", Options(expand=True, **o), cwd=str(project))]
    assert names() == ["arch/a.zip/doc/d.md", "arch/a.zip/src/k.go"]
    assert names(hidden=True)[0] == "arch/a.zip/.h"
    assert names(globs=(include("arch/a.zip/src/**"),)) == ["arch/a.zip/src/k.go"]
    assert names(globs=(exclude("doc/"),)) == ["arch/a.zip/src/k.go"]
    assert names(globs=(exclude("*.zip"),)) == []


def test_repositories_are_read_as_checkouts(spark):
    data = zipped({"r-main/": b"", "r-main/.gitignore": b"*.log\n", "r-main/x.log": b"", "r-main/src/m.go": b"m", "r-main/src/.lxignore": b"n.go\n", "r-main/src/n.go": b"", "r-main/docs/d.md": b"d"})
    fetched = []

    def fetcher(url):
        fetched.append(url)
        return data, "application/zip"

    got = inputs.collect("https://github.com/o/r", Options(globs=(exclude("docs/**"),)), fetcher=fetcher)
    assert [(i.path, i.entry, i.content) for i in got] == [("https://github.com/o/r/src/m.go", "r-main/src/m.go", b"m")]
    assert fetched == ["https://github.com/o/r/archive/HEAD.zip"]


def test_web_inputs(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("404 Not Found")
        return b"body", "text/html"

    got = web.fetch_urls(spark.createDataFrame([("http://a/x",), ("http://bad/",)], "url string"), fetcher).collect()
    assert sorted((x["url"], x["content"], x["media_type"], x["failure"]) for x in got) == [("http://a/x", b"body", "text/html", None), ("http://bad/", None, None, "url: 404 Not Found")]
    assert web.is_http_url("HTTPS://x.y/z") and not web.is_http_url("ftp://x") and not web.is_http_url("http://")
    [one] = inputs.collect("http://a/x.zip", Options(), fetcher=fetcher)
    assert (one.path, one.size) == ("http://a/x.zip", -1)
    [bad] = inputs.collect("http://bad/x.zip", Options(expand=True), fetcher=fetcher)
    assert bad.failure.startswith("url: download")


def test_lists_and_standard_input(project):
    assert inputs.path_list(b" a \n\nb\r\n") == ["a", "b"]
    assert inputs.path_list(b" a \0b\n\0", nul=True) == [" a ", "b\n"]
    assert inputs.standard_input(b"abc", 2).failure and inputs.standard_input(b"abc").content == b"abc"
    options = Options(globs=(exclude("src/"),))
    piped = [inputs.collect(p, options, cwd=str(project), piped=True) for p in ("./src/app.go", "main.go", ".gitignore")]
    assert [[i.path for i in x] for x in piped] == [[], ["main.go"], [".gitignore"]]
    twice = inputs.collect("main.go", cwd=str(project)) + inputs.collect("./main.go", cwd=str(project))
    assert len(inputs.distinct_inputs(twice)) == 1


def test_output_is_never_an_input(project):
    out = str(project / "main.go")
    assert "main.go" not in found(project, output=out) and found(project, "main.go", output=out) == []


def test_prompts(tmp_path):
    tree(tmp_path, {"go/test.md": "", "test.md": "", "a/dup.md": "", "b/dup.md": "", "area/sub/note.md": "", "area/note.md": "", "plan.txt": ""}, repo=False)
    find = lambda n: os.path.relpath(inputs.find_prompt(n, str(tmp_path)), tmp_path)
    assert [find(n) for n in ("test", "go/test", "note", "sub/note", "plan.txt")] == ["test.md", "go/test.md", "area/note.md", "area/sub/note.md", "plan.txt"]
    with pytest.raises(LookupError, match="ambiguous"):
        find("dup")
    with pytest.raises(LookupError, match="not found"):
        find("none")


def test_settings(tmp_path):
    tree(tmp_path, {"quillstack/ignore": "# c\n*.a\n", "git/ignore": "*.b"}, repo=False)
    assert inputs.user_ignore_rules({"XDG_CONFIG_HOME": str(tmp_path)}) == ("*.a", "*.b")
    assert inputs.merge_config({"a": 1, "t": {"x": "1"}}, {"a": 0, "t": {"y": "2"}}, {"b": True}) == {"a": 1, "t": {"x": "1", "y": "2"}, "b": True}
    from datetime import UTC, datetime

    fields = inputs.system_context(["-n", "3", "a b"], "1", datetime(2024, 5, 1, tzinfo=UTC))
    body = inputs.context_body(fields | {"zone": "x", "empty": ""})
    assert body.startswith("OS: ") and "Time: 2024-05-01T00:00:00+00:00\n" in body and "Command: quillstack -n 3 'a b'\n" in body and body.endswith("zone: x\n")


def test_rejected_paths_say_why(spark, tmp_path):
    root = tree(tmp_path / "r", {".ignore": "*.log\n", "a.log": "", "b.py": "", ".hid/x": "", "sub/c.txt": "", "sub/deep/d.log": "", "out/e.py": ""})
    os.symlink(root / "sub", root / "ln")
    got = {r["path"]: r["reason"] for r in walk.rejected_paths(spark, ".", Options(globs=(exclude("out"),)), str(root)).collect()}
    assert got == {".git": "hidden", ".ignore": "hidden", ".hid": "hidden", "a.log": "ignore rule", "sub/deep/d.log": "ignore rule", "out": "excluded by a glob", "ln": "link"}
    got = {r["path"]: r["reason"] for r in walk.rejected_paths(spark, ".", Options(globs=(include("sub/**"),)), str(root)).collect()}
    assert got["b.py"] == "not included by a glob" and got["out"] == "no include glob reaches below it"


def test_partitions_of_a_deep_tree_do_not_follow_its_top(tmp_path):
    root = tree(tmp_path / "d", {f"one/{i}/{j}/f.txt": "" for i in range(6) for j in range(6)} | {"one/top.txt": "", "x.txt": ""})
    reader = walk._Reader(Options(), ".", str(root), least=20)
    parts = reader.partitions()
    assert len(parts) >= 20
    found = [row[0] for part in parts for row in reader.read(part)]
    assert sorted(found) == sorted(e.path for e in Walker(Options(), ".", str(root)).walk()) and len(found) == 38


@pytest.mark.parametrize(
    "address",
    [
        "github.com/o/r", " https://GitHub.com/o/r.git ", "https://github.com/o/r/tree/dev/x", "https://github.com/o", "https://github.com/o/r/issues", "gitlab.com/g/s/p", "https://gitlab.com/g/p/-/tree/v1",
        "https://gitlab.com/g/p/-", "https://gitlab.com/g/-/p", "bitbucket.org/o/r/src/main", "https://codeberg.org/o/r/src/branch/b?x=1#y", "https://example.org/o/r", "src/main.py", "", "ftp://github.com/o/r", "github.com//o/r//",
    ],
)
def test_repository_addresses_on_the_driver_and_as_a_column(spark, address):
    assert names.repo_archive_of(address) == spark.range(1).select(names.repo_archive_url(F.lit(address)).alias("u")).first()["u"]


def lzip(data):
    packer = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}])
    body = packer.compress(data) + packer.flush()
    return b"LZIP\1\x14" + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(8, "little") + (len(body) + 26).to_bytes(8, "little")


def framed_snappy(data):
    out = b"\xff\x06\0\0sNaPpY"
    for k, at in enumerate(range(0, len(data), 60_000)):
        part = data[at : at + 60_000]
        body = b"crc_" + (part if k % 2 else pa.Codec("snappy").compress(part, asbytes=True))
        out += bytes([k % 2]) + len(body).to_bytes(3, "little") + body + b"\xfe\2\0\0ab"
    return out


PACKERS = {"lz4": lambda d: pa.Codec("lz4").compress(d, asbytes=True), "br": lambda d: pa.Codec("brotli").compress(d, asbytes=True), "sz": framed_snappy, "lz": lambda d: lzip(d[:7]) + lzip(d[7:])}


@pytest.mark.parametrize("suffix", PACKERS)
def test_other_compressions(suffix):
    text = b"".join(b"line %d of it\n" % k for k in range(20_000))
    packed = PACKERS[suffix](text)
    [one] = archives.expand(packed, f"d/notes.txt.{suffix}")
    assert (one.key, one.size, one.content, one.failure) == ("notes.txt", len(text), text, None)
    [over] = archives.expand(packed, f"notes.txt.{suffix}", limit=100)
    assert (over.size, over.content) == (101, None)
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("a/b.txt")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    [entry] = archives.expand(PACKERS[suffix](inner.getvalue()), f"all.tar.{suffix}")
    assert (entry.key, entry.content) == ("a/b.txt", text)
    assert archives.expand(packed[: len(packed) // 2], f"notes.txt.{suffix}")[0].failure or suffix in ("lz4", "br")
    assert all(m.failure for m in archives.expand(b"nothing of the kind" * 9, f"odd.{suffix}"))
