import os

from quillstack.streaming import bundles


def test_a_watched_folder_is_rendered_once_per_file(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    (source / "a.py").write_text("x = 1\ny = 2\n")
    (source / "b.bin").write_bytes(b"\0\1")

    def run():
        stream = bundles.render_stream(bundles.watch_folder(spark, str(source)))
        query = bundles.append_bundle(stream, str(out), str(state)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return "".join((d / n).read_text() for d in sorted(out.iterdir()) for n in sorted(os.listdir(d)) if n.startswith("part-"))

    got = run()
    assert "a.py (2 rows)\n---\n```python\nx = 1\ny = 2\n```" in got and "b.bin - binary file skipped (2 B)" in got
    (source / "c.md").write_text("# new\n")
    again = run()
    assert again.count("a.py") == 1 and "```markdown\n# new\n```" in again


def test_window_totals_of_a_table_equal_plain_sums(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.txt").write_text("line\n" * (k + 1))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = bundles.window_totals(bundles.render_stream(files)).collect()
    assert (sum(r["files"] for r in rows), sum(r["rows"] for r in rows), sum(r["bytes"] for r in rows)) == (5, 15, 75)
