"""Inputs of a bundle: what a target names, lists of paths, buffers, streams, prompt libraries, user settings."""

from __future__ import annotations

import os
import platform
import shlex
import socket
from dataclasses import dataclass, replace
from datetime import datetime

from ..functions.names import repo_archive_of
from .archives import STREAMS, expand, is_archive_name
from .walk import CONTENT_LIMIT, Entry, Options, Walker, accepts_piped, last_match, read_stream
from .web import Fetcher, fetch, is_http_url, repository_files


@dataclass(frozen=True)
class Input:
    """One input, or a failure.  `content` is set where it is in memory already; `key` tells equal inputs."""

    path: str
    abs_path: str = ""
    archive: str = ""
    entry: str = ""
    size: int = -1
    mod_time: datetime | None = None
    media_type: str = ""
    content: bytes | None = None
    failure: str | None = None

    @property
    def key(self) -> str:
        return f"{self.archive}/{self.entry}" if self.archive else self.abs_path


def buffer(path: str, content: bytes) -> Input:
    return Input(path, path, size=len(content), content=content)


def path_list(data: bytes, nul: bool = False) -> list[str]:
    """Paths of a list: lines are trimmed and blank ones skipped; NUL-ended names are taken as they are."""
    text = data.decode("utf-8", "surrogateescape")
    return [p for p in text.split("\0") if p] if nul else [p.strip() for p in text.split("\n") if p.strip()]


def standard_input(data: bytes, limit: int = 0) -> Input:
    """The content of standard input as a file of its own, up to the limit."""
    cap = limit or CONTENT_LIMIT
    if len(data) > cap:
        return Input("stdin", "stdin", failure=f"read: stopped reading after {cap} bytes (-m sets the limit)")
    return Input("stdin", "stdin", size=len(data), content=data)


def _from_entry(e: Entry) -> Input:
    return Input(e.path, e.abs_path, size=e.size, mod_time=e.mod_time, failure=e.failure)


def _expanded(archive: Input, options: Options, shown: str, data: bytes, limit: int) -> list[Input]:
    """An archive's entries; globs match them as paths below the archive, hidden ones are skipped like hidden files."""

    def skips(path: str, name: str, is_dir: bool) -> bool:
        kept = last_match(options.globs, f"{shown}/{path}", is_dir)
        if kept is None and options.whitelist and not is_dir:
            kept = False
        return kept is False or kept is None and not options.hidden and name.startswith(".")

    def keep(key: str, is_dir: bool) -> bool:
        parts = key.split("/")
        single = len(parts) == 1 and archive.path.endswith(tuple(f".{x}" for x in STREAMS)) and parts[0].startswith(".")
        inside = any(skips("/".join(parts[:k]), parts[k - 1], True) for k in range(1, len(parts)))
        return not inside and not skips(key, "" if single else parts[-1], is_dir)

    origin = archive.abs_path or archive.path
    return [Input(f"{archive.path}/{m.key}" if m.key else archive.path, origin, origin, m.entry, m.size, m.mod_time, content=m.content, failure=m.failure) for m in expand(data, archive.path, keep, limit)]


def collect(target: str, options: Options = Options(), limit: int = 0, cwd: str | None = None, piped: bool = False, fetcher: Fetcher = fetch) -> list[Input]:
    """What a target names: a repository, a web address, or a local path, in this order.  Failures are rows, never raised.

    For large trees walk_files() gives the same files as a distributed table.
    """
    if archive_url := repo_archive_of(target):
        return [Input(m.key, m.key, archive_url, m.entry, m.size, m.mod_time, content=m.content, failure=m.failure) for m in repository_files(target, archive_url, options, limit, fetcher)]
    if is_http_url(target):
        if options.expand and is_archive_name(target.split("?")[0].split("#")[0]):
            try:
                data, _ = fetcher(target)
            except (OSError, ValueError) as error:
                return [Input(target, target, failure=f"url: download {target}: {error}")]
            return _expanded(Input(target.rstrip("/"), target), options, target.rstrip("/"), data, limit)
        return [Input(target, target)]
    cwd = cwd or os.getcwd()
    if piped:
        target = os.path.normpath(target)
        full = os.path.join(cwd, target)
        if not accepts_piped(options, target, os.path.isdir(full) or options.expand and is_archive_name(target)):
            return []
    walker = Walker(options, target, cwd)
    out = []
    for e in walker.walk():
        if options.expand and is_archive_name(e.path) and not e.failure:
            data, failure = read_stream(e.abs_path, limit)
            rel = os.path.relpath(e.abs_path, os.path.realpath(walker.root)) if os.path.isdir(walker.root) else "."
            listed = [] if failure else _expanded(_from_entry(e), options, walker.globbed(rel), data, limit)
            # Names and sizes only: executors read the contents from the archive again.
            out += [replace(_from_entry(e), failure=failure)] if failure else [replace(i, content=None) for i in listed]
        else:
            out.append(_from_entry(e))
    return out


def distinct_inputs(found: list[Input]) -> list[Input]:
    """Of inputs with equal keys the first."""
    seen: set[str] = set()
    return [i for i in found if not (i.key in seen or seen.add(i.key))]


# Prompt libraries


def list_prompts(folder: str) -> list[tuple[str, str]]:
    """(relative path, absolute path) of the library's files, sorted."""
    found = [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files]
    return sorted((os.path.relpath(p, folder), os.path.abspath(p)) for p in found)


def find_prompt(name: str, folder: str, extension: str = ".md") -> str:
    """The file that a prompt's name means: a path, an exact library path, one with the extension, or the shallowest
    file of that relative path or base name.  Several at that depth are an error."""
    if os.path.isabs(name) or name.startswith(("./", "../", "~")):
        return os.path.expanduser(name)
    for direct in (name, name + extension):
        if os.path.isfile(os.path.join(folder, direct)):
            return os.path.join(folder, direct)
    hits = [(rel.count("/"), rel) for rel, _ in list_prompts(folder) if os.path.splitext(rel)[0] == name or os.path.splitext(rel)[0].endswith("/" + name) or rel.endswith("/" + name)]
    if not hits:
        raise LookupError(f"prompt {name!r} not found in {folder}")
    depth = min(hits)[0]
    best = sorted(rel for d, rel in hits if d == depth)
    if len(best) > 1:
        raise LookupError(f"prompt {name!r} is ambiguous: {', '.join(best)}")
    return os.path.join(folder, best[0])


# Settings


def config_home(env=os.environ) -> str:
    return env.get("XDG_CONFIG_HOME") or os.path.join(env.get("HOME", ""), ".config")


def user_ignore_rules(env=os.environ, app: str = "quillstack") -> tuple[str, str]:
    """The user's own ignore rules and git's global excludes."""

    def rules(*parts):
        try:
            with open(os.path.join(config_home(env), *parts), encoding="utf-8") as f:
                return "\n".join(line.strip() for line in f if line.strip() and not line.strip().startswith("#"))
        except OSError:
            return ""

    return rules(app, "ignore"), rules("git", "ignore")


def merge_config(*layers: dict | None) -> dict:
    """Settings of several layers: a later one's set values win, and mappings merge."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            if isinstance(value, dict):
                out[key] = merge_config(out.get(key), value)
            elif value not in (None, "", 0):
                out[key] = value
    return out


# Labels of a system context, in order.
CONTEXT_LABELS = (("os", "OS"), ("arch", "Arch"), ("time", "Time"), ("host", "Host"), ("version", "Tool"), ("command", "Command"))


def system_context(arguments: list[str], version: str, now: datetime) -> dict[str, str]:
    command = " ".join(["quillstack", *(a if a and not set(a) & set(" \t\"'") else shlex.quote(a) if "'" not in a else '"' + a.replace('"', '\\"') + '"' for a in arguments)])
    return {"os": platform.system().lower(), "arch": platform.machine(), "time": now.isoformat(timespec="seconds"), "host": socket.gethostname(), "version": f"quillstack {version}", "command": command}


def context_body(fields: dict[str, str]) -> str:
    """The known fields in their order, then others by name; empty ones are left out."""
    known = dict(CONTEXT_LABELS)
    lines = [f"{label}: {fields[k]}" for k, label in CONTEXT_LABELS if fields.get(k)]
    return "".join(line + "\n" for line in lines + [f"{k}: {fields[k]}" for k in sorted(fields) if k not in known and fields[k]])
