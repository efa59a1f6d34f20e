"""File discovery: a tree walk under ignore files, globs and link policy, on the driver or as a Spark data source.

The walk itself is plain Python over os.scandir; as the data source `bundle_files` each directory below the root is an
input partition, so executors walk subtrees side by side.  It returns metadata only: read_content() fetches bytes in
a step of its own, which Catalyst drops where no column needs it.
"""

from __future__ import annotations

import json
import os
import posixpath
import stat
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.globs import Rule, parse_ignore
from .archives import is_archive_name

SCHEMA = "path string, abs_path string, size long, mod_time timestamp, failure string"
CONTENT_LIMIT = 64_000_000


@dataclass(frozen=True)
class Options:
    """What a walk takes and leaves.  `ignore_rules` apply below repository roots (or the top), `git_excludes` in them."""

    globs: tuple[Rule, ...] = ()
    ignore_rules: str = ""
    git_excludes: str = ""
    hidden: bool = False
    no_ignore: bool = False
    follow: bool = False
    no_links: bool = False
    expand: bool = False
    output: str = ""

    @property
    def whitelist(self) -> bool:
        return any(r.whitelist for r in self.globs)


@dataclass(frozen=True)
class Entry:
    """A file found at `path` (shown) and `abs_path`; `failure` says why something could not be read."""

    path: str
    abs_path: str
    size: int = -1
    mod_time: datetime | None = None
    failure: str | None = None


def last_match(rules, path: str, is_dir: bool) -> bool | None:
    """Whether the last rule that matches keeps the path; None if none does."""
    for rule in reversed(rules):
        if rule.matches(path, is_dir):
            return rule.keep
    return None


def git_folder(folder: str) -> str | None:
    """The git directory of a repository root: a .git directory with a HEAD, or the one that a .git file names."""
    dot = os.path.join(folder, ".git")
    if os.path.isdir(dot):
        return dot if os.path.exists(os.path.join(dot, "HEAD")) else None
    try:
        with open(dot, encoding="utf-8", errors="replace") as f:
            line = f.readline().strip()
    except OSError:
        return None
    target = line.removeprefix("gitdir:").strip() if line.startswith("gitdir:") else ""
    return os.path.normpath(os.path.join(folder, target)) if target else None


def _text(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="surrogateescape", newline="") as f:
            return f.read()
    except OSError:
        return ""


@dataclass
class Frame:
    """The ignore rules in effect in a directory; those of `.ignore` and `.lxignore` outlive repository roots."""

    git: list[Rule] = field(default_factory=list)
    other: list[Rule] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    in_repo: bool = False


#: Names of ignore files, the later ranking higher; the first counts in repositories only.
GIT_FILE, IGNORE_FILES = ".gitignore", (".ignore", ".lxignore")


class Frames:
    """Frames by directory, each from its parent's, up to the file system's root."""

    def __init__(self, options: Options):
        self.options, self.known = options, {}

    def of(self, folder: str) -> Frame:
        if (found := self.known.get(folder)) is None:
            found = self.known[folder] = self._made(folder)
        return found

    def _made(self, folder: str) -> Frame:
        if self.options.no_ignore:
            return Frame()
        above = os.path.dirname(folder)
        top = above == folder
        parent = Frame() if top else self.of(above)
        git = git_folder(folder)
        base = parse_ignore(self.options.ignore_rules, folder) if top or git else []
        frame = Frame(in_repo=bool(git) or parent.in_repo)
        own: list[tuple[bool, Rule]] = []
        if git:
            base += parse_ignore(self.options.git_excludes, folder)
            common = _text(os.path.join(git, "commondir")).strip()
            shared = os.path.normpath(os.path.join(git, common)) if common else git
            own += [(False, r) for r in parse_ignore(_text(os.path.join(shared, "info", "exclude")), folder)]
        if frame.in_repo:
            own += [(False, r) for r in parse_ignore(_text(os.path.join(folder, GIT_FILE)), folder)]
        for name in IGNORE_FILES:
            own += [(True, r) for r in parse_ignore(_text(os.path.join(folder, name)), folder)]
        frame.other = parent.other + [r for lasting, r in own if lasting]
        frame.rules = ([*base, *parent.other] if git or top else parent.rules) + [r for _, r in own]
        return frame


class Walker:
    """A walk of one root.  `shown` is the root as it was named: globs see it so, without "./" and a trailing "/"."""

    def __init__(self, options: Options, shown: str, cwd: str | None = None, on_ignore: Callable[[str, str], None] | None = None):
        self.options, self.frames, self.on_ignore = options, Frames(options), on_ignore
        self.cwd = cwd or os.getcwd()
        self.root = os.path.normpath(os.path.join(self.cwd, shown))
        self.display = os.path.normpath(shown)
        named = shown.rstrip("/") or "/"
        while named.startswith("./"):
            named = named[2:].lstrip("/")
        if os.path.isabs(named) and (named == self.cwd or named.startswith(self.cwd + "/")):
            named = named[len(self.cwd) + 1 :]
        self.anchor = "" if named in (".", "") else named

    def globbed(self, rel: str) -> str:
        """The path that globs match for a path below the root."""
        return posixpath.join(self.anchor, rel) if rel != "." else self.anchor or "."

    def shown(self, rel: str) -> str:
        return rel if self.display == "." else os.path.join(self.display, rel)

    def skips(self, folder: str, name: str, rel: str, is_dir: bool) -> str:
        """Why an entry is skipped, if it is: globs first, then ignore rules, then hidden names, which a keeping rule lifts."""
        options = self.options
        path = self.globbed(rel)
        kept, why = last_match(options.globs, path, is_dir), "excluded by a glob"
        if kept is None and options.whitelist and not is_dir:
            kept, why = False, "not included by a glob"
        if kept is None:
            kept, why = last_match(self.frames.of(folder).rules, os.path.join(folder, name), is_dir), "ignore rule"
            if kept is None and not options.hidden and name.startswith("."):
                kept, why = False, "hidden"
        if kept is False:
            return why
        return "no include glob reaches below it" if is_dir and not self.reaches(path) else ""

    def reaches(self, path: str) -> bool:
        """Whether, with include globs, one of those that keep files could match below a directory."""
        return not self.options.whitelist or any(r.reaches(path) for r in self.options.globs if r.keep and not r.dirs_only)

    def entries(self, folder: str, rel: str, ancestors: tuple = ()) -> Iterator[Entry | tuple]:
        """Files of a directory and (folder, rel, ancestors) for the directories in it, in walk order."""
        try:
            with os.scandir(folder) as found:
                children = sorted(found, key=lambda e: os.fsencode(e.name))
        except OSError as error:
            yield Entry(self.shown(rel), folder, failure=f"walk: {error.strerror}")
            return
        for child in children:
            below = child.name if rel == "." else f"{rel}/{child.name}"
            link, target = child.is_symlink(), None
            try:
                target = child.stat()
                is_dir = stat.S_ISDIR(target.st_mode)
            except OSError:
                is_dir = False
            if link and (is_dir and (not self.options.follow or (target.st_dev, target.st_ino) in ancestors) or not is_dir and self.options.no_links):
                self._ignored(below, "link")
                continue
            as_dir = is_dir or self.options.expand and is_archive_name(child.name)
            if why := self.skips(folder, child.name, below, as_dir):
                self._ignored(below, why)
                continue
            path = os.path.join(folder, child.name)
            if is_dir:
                yield path, below, (*ancestors, (target.st_dev, target.st_ino))
            elif os.path.normpath(path) != (self.options.output or None):
                if target is None:
                    yield Entry(self.shown(below), path, failure="stat: no such file or directory")
                elif stat.S_ISREG(target.st_mode):  # what is walked but no file is skipped: a pipe could block
                    yield Entry(self.shown(below), path, target.st_size, datetime.fromtimestamp(target.st_mtime, UTC))

    def _ignored(self, rel: str, why: str) -> None:
        if self.on_ignore:
            self.on_ignore(self.shown(rel), why)

    def walk(self, folder: str | None = None, rel: str = ".", ancestors: tuple | None = None) -> Iterator[Entry]:
        """Depth first, each directory's entries by name.  A root that is a file is never filtered."""
        if folder is None:
            try:
                info = os.stat(self.root)
            except OSError as error:
                if self.root != self.options.output:
                    yield Entry(self.display, self.root, failure=f"stat: {error.strerror.lower()}")
                return
            if not stat.S_ISDIR(info.st_mode):
                if self.root != self.options.output:
                    size = info.st_size if stat.S_ISREG(info.st_mode) else -1
                    yield Entry(self.display, self.root, size, datetime.fromtimestamp(info.st_mtime, UTC))
                return
            # The rules above a linked root are those above its target.
            folder, ancestors = os.path.realpath(self.root), ((info.st_dev, info.st_ino),)
        for found in self.entries(folder, rel, ancestors or ()):
            if isinstance(found, Entry):
                yield found
            else:
                yield from self.walk(*found)


def accepts_piped(options: Options, path: str, is_dir: bool = False) -> bool:
    """Whether globs let a path from a list through: it and every directory above it, without ignore files."""
    path = os.path.normpath(path)
    if path == ".":
        return True
    parts = path.split("/")
    start = next((i for i, p in enumerate(parts) if p != ".."), len(parts))
    if not os.path.isabs(path):
        for end in range(start + 1, len(parts)):
            if last_match(options.globs, "/".join(parts[:end]), True) is False:
                return False
    kept = last_match(options.globs, path, is_dir)
    return kept is not False if kept is not None or not options.whitelist or is_dir else False


@dataclass
class Subtree(InputPartition):
    """A directory with what is below it or, if it is listed alone, only the files in it."""

    folder: str
    rel: str
    ancestors: tuple
    alone: bool = False


class _Reader(DataSourceReader):
    """Partitions are subtrees: the top is opened level by level until there are enough of them, whatever its shape.

    With `rejected`, the rows are what the walk skips; the failure says why.
    """

    def __init__(self, options: Options, shown: str, cwd: str, rejected: bool = False, least: int = 128):
        self.options, self.named, self.cwd, self.rejected, self.least = options, shown, cwd, rejected, least

    def partitions(self):
        walker = Walker(self.options, self.named, self.cwd)
        if not os.path.isdir(walker.root):
            return [Subtree("", "", ())]
        info = os.stat(walker.root)
        alone, deep = [], [Subtree(os.path.realpath(walker.root), ".", ((info.st_dev, info.st_ino),))]
        while deep and len(deep) < self.least and len(alone) < self.least:
            level, deep = deep, []
            for part in level:
                if len(alone) >= self.least:
                    deep.append(part)
                    continue
                alone.append(replace(part, alone=True))
                deep += [Subtree(*found) for found in walker.entries(part.folder, part.rel, part.ancestors) if isinstance(found, tuple)]
        return alone + deep

    def read(self, partition):
        said: list[tuple[str, str]] = []
        walker = Walker(self.options, self.named, self.cwd, (lambda path, why: said.append((path, why))) if self.rejected else None)
        ancestors = tuple(map(tuple, partition.ancestors))
        if partition.alone:
            found = (e for e in walker.entries(partition.folder, partition.rel, ancestors) if isinstance(e, Entry))
        else:
            found = walker.walk(partition.folder, partition.rel, ancestors) if partition.folder else walker.walk()
        for e in found:
            if not self.rejected:
                yield e.path, e.abs_path, e.size, e.mod_time, e.failure
            while said:
                path, why = said.pop()
                yield path, None, None, None, why
        for path, why in said:
            yield path, None, None, None, why


class BundleFiles(DataSource):
    """`spark.read.format("bundle_files").option("path", root)`; option "options" is Options as to_json() writes it."""

    @classmethod
    def name(cls):
        return "bundle_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(from_json(self.options.get("options", "{}")), self.options["path"], self.options.get("cwd") or os.getcwd(), self.options.get("rejected") == "true")


def to_json(options: Options) -> str:
    return json.dumps(asdict(options))


def from_json(text: str) -> Options:
    raw = json.loads(text)
    return replace(Options(), **raw | {"globs": tuple(Rule(**r) for r in raw.get("globs", ()))})


def walk_files(spark, root: str, options: Options = Options(), cwd: str | None = None) -> DataFrame:
    """The files below a root, unordered; sort by split(path, '/') for walk order."""
    spark.dataSource.register(BundleFiles)
    return spark.read.format("bundle_files").option("path", root).option("cwd", cwd or os.getcwd()).option("options", to_json(options)).load()


def rejected_paths(spark, root: str, options: Options = Options(), cwd: str | None = None) -> DataFrame:
    """(path, reason) of everything that the walk skips; what is below a skipped directory isn't visited."""
    spark.dataSource.register(BundleFiles)
    rows = spark.read.format("bundle_files").option("path", root).option("cwd", cwd or os.getcwd()).option("options", to_json(options)).option("rejected", "true").load()
    return rows.select("path", F.col("failure").alias("reason"))


def read_stream(path: str, limit: int = 0) -> tuple[bytes | None, str | None]:
    """Content of a file, pipe or device and why it could not be read; what isn't a plain file stops at a cap."""
    try:
        plain = stat.S_ISREG(os.stat(path).st_mode)
        if os.path.isdir(path):
            return None, "read: is a directory"
        with open(path, "rb") as f:
            if plain:
                return f.read(), None
            cap = limit or CONTENT_LIMIT
            data = f.read(cap + 1)
            return (data, None) if len(data) <= cap else (None, f"read: stopped reading after {cap} bytes (-m sets the limit)")
    except OSError as error:
        return None, f"read: {error.strerror.lower()}"


def read_content(files: DataFrame, limit: int = 0) -> DataFrame:
    """Adds content (binary) and, where it can't be read, a failure.  Executors must see the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # one file at a time: contents may be large
                data, failure = (None, row["failure"]) if row["failure"] else read_stream(row["abs_path"], limit)
                one = pa.RecordBatch.from_pylist([row | {"failure": failure}], schema=batch.schema)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], [*batch.schema.names, "content"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def in_walk_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.split("path", "/"))
