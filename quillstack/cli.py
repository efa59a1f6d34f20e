"""The command line: `python -m quillstack [options and inputs in order]`."""

from __future__ import annotations

import logging
import os
import re
import shutil
import subprocess
import sys

from .plans.arguments import DEFINITIONS, SCOPED, ArgumentError, parse
from .plans.bundle import VERSION, Bundle, stats_text
from .plans.templates import TemplateError
from .sources import inputs

log = logging.getLogger("quillstack")
#: What each option does, for --help.
USAGE = {
    "copy": "copy the document to the clipboard", "output": "write the document to a file", "md": "Markdown (the default)", "xml": "XML tags",
    "html": "one HTML page", "bare": "contents only", "stdout": "write to standard output", "null": "piped names end with NUL",
    "line-numbers": "number lines", "lines": "N lines of each file, half from its end; 0 for headers only", "head": "the first N lines", "tail": "the last N lines",
    "include": "keep what matches a glob", "exclude": "drop what matches a glob", "max-size": "leave larger files out", "documents": "convert documents to text",
    "media": "describe media files", "expand": "read archives as directories", "hidden": "take hidden files", "follow": "follow links to directories",
    "no-links": "leave links to files out", "no-ignore": "read no ignore files", "functions": "only signatures of functions", "types": "only definitions of types",
    "tree": "draw the tree of the files around it", "tree-only": "draw the tree of the files after it instead of them", "section": "start a section with a title",
    "system-context": "describe this system", "prompt": "add a text", "prompt-file": "add a text of the prompt library", "prompts-dir": "the prompt library",
    "list-prompts": "list the prompt library", "config": "a settings file", "quiet": "log nothing", "verbose": "log more", "stats": "show a summary",
    "no-stats": "show no summary", "version": "show the version", "help": "show this text",
}
CLIPBOARDS = (("pbcopy",), ("wl-copy",), ("xclip", "-selection", "clipboard"), ("clip",))


def help_text() -> str:
    lines = ["usage: quillstack [options and inputs in order]", ""]
    for name, short, kind, takes in DEFINITIONS:
        flag = (f"-{short}, " if short else "    ") + f"--{name}" + ("" if takes == "none" else f" <{takes}>")
        lines.append(f"  {flag:<28} {USAGE[name]}" + (" (for what follows)" if kind == SCOPED else ""))
    return "\n".join(lines) + "\n"


def read_settings(text: str) -> dict:
    """A settings file: `key: value` lines with plain, quoted, list or block (| and |-) values, the part of YAML that
    settings need; anything else is an error."""
    out: dict = {}
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"([A-Za-z_]\w*):(?:\s+(.*?))?\s*$", line)
        if not m:
            raise ValueError(f"settings line {i}: {line.strip()!r}")
        key, value = m[1], m[2] or ""
        if value in ("|", "|-", "|+"):
            block = []
            while i < len(lines) and (not lines[i].strip() or lines[i].startswith(" ")):
                block.append(lines[i])
                i += 1
            indent = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
            body = "\n".join(x[indent:] for x in block).rstrip("\n")
            out[key] = body if value == "|-" else body + "\n"
        elif not value and i < len(lines) and re.match(r"\s*- ", lines[i]):
            out[key] = []
            while i < len(lines) and (m := re.match(r"\s*- (.*)", lines[i])):
                out[key].append(_scalar(m[1].strip()))
                i += 1
        else:
            out[key] = _scalar(value)
    return out


def _scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] == '"':
        return text[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape") if "\\" in text else text[1:-1]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    text = re.sub(r"\s+#.*$", "", text)
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "": None, "null": None, "~": None}.get(text, int(text) if re.fullmatch(r"-?\d+", text) else text)


def load_config(named: str | None, env=os.environ) -> dict:
    """The user's settings, those of $QUILLSTACK_CONFIG, and a named file, each over the ones before.

    Only a named file must be there and be right; the others are skipped with a warning.
    """
    layers = []
    for path, strict in ((os.path.join(inputs.config_home(env), "quillstack", "config.yaml"), False), (env.get("QUILLSTACK_CONFIG"), False), (named, True)):
        if not path:
            continue
        try:
            with open(path, encoding="utf-8") as f:
                layers.append(read_settings(f.read()))
        except (OSError, ValueError) as error:
            if strict:
                raise
            if not isinstance(error, FileNotFoundError):
                log.warning("settings file %s skipped: %s", path, error)
    return inputs.merge_config({"output_mode": "stdout", "show_stats": "auto", "verbosity": "warn"}, *layers)


def log_level(settings: dict, verbosity: str, times: int) -> int:
    """-q silences; -v and -vv raise; --verbose=level names one; else the settings'."""
    if "quiet" in settings:
        return logging.CRITICAL + 1
    named = settings.get("verbose")
    level = named if named and named != "true" else ("debug" if times > 1 else "info" if times else verbosity)
    return {"error": logging.ERROR, "warn": logging.WARNING, "warning": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG}.get(level, logging.WARNING)


def copy_to_clipboard(text: str) -> None:
    for command in CLIPBOARDS:
        if shutil.which(command[0]):
            subprocess.run(command, input=text.encode(), check=True)
            return
    raise OSError("no clipboard tool found")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillstack").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(arguments: list[str], spark=None, cwd: str | None = None, stdin=None, env=os.environ, out=None, err=None) -> int:
    """Exit status: 0, or 1 for wrong arguments, settings or templates.  Inputs that can't be read are logged only."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        parsed = parse(arguments)
        settings = parsed.settings
        if "help" in settings or "version" in settings:
            out.write(help_text() if "help" in settings else f"quillstack {VERSION}\n")
            return 0
        config = load_config(settings.get("config"), env)
        log.setLevel(log_level(settings, config.get("verbosity", "warn"), sum(op.name == "verbose" for op in parsed.ops)))
        if "list-prompts" in settings:
            for rel, full in inputs.list_prompts(settings.get("prompts-dir") or config.get("prompts_dir", "")):
                out.write(f"{rel}\t{full}\n")
            return 0
        bundle = Bundle.from_arguments(spark or session(), arguments, cwd, stdin, config)
        for warning in bundle.warnings:
            log.warning(warning)
        copies = "copy" in settings or config.get("output_mode") == "copy" and not {"stdout", "output"} & set(settings)
        say = lambda path, failure: log.error("%s: %s", path, failure)
        if bundle.output:
            report = bundle.write(on_failure=say)
        else:
            report = bundle.write(to=out, also=copy_to_clipboard if copies else None, on_failure=say)
    except (ArgumentError, TemplateError, LookupError, OSError, ValueError) as error:
        err.write(f"quillstack: {error}\n")
        return 1
    shown = {"always": True, "never": False}.get(config.get("show_stats"), bool({"copy", "output"} & set(settings)))
    if ("stats" in settings or shown) and "no-stats" not in settings:
        color = "NO_COLOR" not in env and err.isatty()
        err.write(stats_text(report, color, config.get("stats_template") or ""))
    return 0
