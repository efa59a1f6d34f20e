import io
import logging

import pytest

from quillstack import cli

from .test_sources import tree


def run(spark, cwd, *args, stdin=None, env=None):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(list(args), spark, str(cwd), stdin, {"XDG_CONFIG_HOME": "/nonexistent"} | (env or {}), out, err)
    return code, out.getvalue(), err.getvalue()


@pytest.fixture
def project(tmp_path):
    return tree(tmp_path / "p", {"a.txt": "one\ntwo\n", "lib/x.md": "prompt text\n"})


def test_output_stats_and_failures(spark, project, caplog):
    with caplog.at_level(logging.ERROR, "quillstack"):
        code, out, err = run(spark, project, "-n0", "a.txt", "none", "--stats")
    assert (code, out) == (0, "a.txt (2 rows)\n\n")
    assert err.startswith("▎ 1 file · 2 rows · 1 section · 8 B\n") and err.endswith("  1 failed\n")
    assert "none: stat: no such file or directory" in caplog.text


def test_files_and_settings(spark, project, tmp_path):
    tree(tmp_path, {"own/quillstack/config.yaml": "output_format: bare\nshow_stats: always\n", "c.yaml": 'file_content_template: |-\n  <{{ .Path }}>\noutput_footer_template: "."\n'}, repo=False)
    code, out, err = run(spark, project, "a.txt", env={"XDG_CONFIG_HOME": str(tmp_path / "own")})
    assert (code, out) == (0, "one\ntwo\n") and "1 file" in err
    code, out, err = run(spark, project, "a.txt", "-y", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "o.md"))
    assert (code, out) == (0, "") and (tmp_path / "o.md").read_text() == "<a.txt>." and "1 file" in err


def test_prompts_help_and_errors(spark, project):
    assert run(spark, project, "--prompts-dir", str(project / "lib"), "--list-prompts")[1] == f"x.md\t{project}/lib/x.md\n"
    assert run(spark, project, "--prompts-dir", str(project / "lib"), "-P", "x")[1] == "prompt text\n\n\n"
    assert run(spark, project, "-V")[1].startswith("quillstack ") and "--line-numbers" in run(spark, project, "-h")[1]
    for bad in (["--nope"], ["-P", "none", "--prompts-dir", str(project / "lib")], ["-y", "/nonexistent.yaml", "a.txt"]):
        code, out, err = run(spark, project, *bad)
        assert (code, out) == (1, "") and err.startswith("quillstack: ")


def test_clipboard(spark, project, monkeypatch):
    held = []
    monkeypatch.setattr(cli, "copy_to_clipboard", held.append)
    code, out, err = run(spark, project, "-c", "-n0", "a.txt")
    assert (code, out, held) == (0, "", ["a.txt (2 rows)\n\n"]) and "1 file" in err


def test_settings_files():
    got = cli.read_settings('# c\na: 1\nb: "x\\n"\nc: \'it\'\'s\'\nd: |-\n  l1\n    l2\n\ne: [md, txt]\nf:\n  - u\n  - v\ng: true # yes\nh:\n')
    assert got == {"a": 1, "b": "x\n", "c": "it's", "d": "l1\n  l2", "e": ["md", "txt"], "f": ["u", "v"], "g": True, "h": None}
    with pytest.raises(ValueError):
        cli.read_settings("- nothing\n")


def test_levels():
    of = lambda args: cli.log_level(cli.parse(args).settings, "warn", sum(op.name == "verbose" for op in cli.parse(args).ops))
    assert [of(a) for a in ([], ["-v"], ["-vv"], ["--verbose=error"])] == [logging.WARNING, logging.INFO, logging.DEBUG, logging.ERROR] and of(["-q"]) > logging.CRITICAL
