"""The argument language: options and inputs in order, compiled to sections of items with their own options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.text import UNITS
from ..operators.globs import GlobError, Rule, exclude, glob_regex, include
from ..sources.walk import Options

GLOBAL, SCOPED, ACTION = "global", "scoped", "action"
# Options as (long name, short name, class, value): value is none, any, number, size, glob or optional.
DEFINITIONS = (
    ("copy", "c", GLOBAL, "none"), ("output", "o", GLOBAL, "any"), ("md", "", GLOBAL, "none"), ("xml", "", GLOBAL, "none"),
    ("html", "", GLOBAL, "none"), ("bare", "", GLOBAL, "none"), ("stdout", "C", GLOBAL, "none"), ("null", "0", GLOBAL, "none"),
    ("line-numbers", "l", SCOPED, "none"), ("lines", "n", SCOPED, "number"), ("head", "", SCOPED, "number"), ("tail", "", SCOPED, "number"),
    ("include", "i", SCOPED, "glob"), ("exclude", "e", SCOPED, "glob"), ("max-size", "m", SCOPED, "size"), ("documents", "D", SCOPED, "none"),
    ("media", "M", SCOPED, "none"), ("expand", "Z", SCOPED, "none"), ("hidden", "H", SCOPED, "none"), ("follow", "S", SCOPED, "none"),
    ("no-links", "", SCOPED, "none"), ("no-ignore", "I", SCOPED, "none"), ("functions", "u", SCOPED, "none"), ("types", "Y", SCOPED, "none"),
    ("tree", "T", ACTION, "none"), ("tree-only", "t", ACTION, "none"), ("section", "s", ACTION, "any"), ("system-context", "E", ACTION, "none"),
    ("prompt", "p", ACTION, "any"), ("prompt-file", "P", ACTION, "any"), ("prompts-dir", "", GLOBAL, "any"), ("list-prompts", "", GLOBAL, "none"),
    ("config", "y", GLOBAL, "any"), ("quiet", "q", GLOBAL, "none"), ("verbose", "v", GLOBAL, "optional"), ("stats", "", GLOBAL, "none"),
    ("no-stats", "", GLOBAL, "none"), ("version", "V", GLOBAL, "none"), ("help", "h", GLOBAL, "none"),
)
LONG = {d[0]: d for d in DEFINITIONS}
SHORT = {d[1]: d for d in DEFINITIONS if d[1]}


class ArgumentError(ValueError):
    pass


@dataclass(frozen=True)
class Op:
    name: str  # an option's long name, or "file"
    value: str
    kind: str


@dataclass
class Parsed:
    settings: dict[str, str] = field(default_factory=dict)
    ops: list[Op] = field(default_factory=list)


def size_of(text: str) -> int:
    """Bytes of a size like 512k or 2MB."""
    m = re.fullmatch(r"\+?(\d{1,19})(gb|mb|kb|g|m|k|b)?", text.strip().lower())
    n = int(m[1]) * UNITS.get(m[2] or "b", 1) if m else 0
    if not 0 < n < 1 << 63:
        raise ArgumentError(f"invalid size {text!r}")
    return n


def check_value(name: str, kind: str, value: str) -> None:
    if kind == "number" and not re.fullmatch(r"[+-]?\d+", value):
        raise ArgumentError(f"option --{name} expects a number, got {value!r}")
    if kind == "size":
        size_of(value)
    if kind == "glob":
        rule = exclude(value) if name == "exclude" else include(value)
        try:
            glob_regex(rule.body)
        except GlobError as error:
            raise ArgumentError(f"option --{name}: invalid glob {value!r}") from error


def parse(arguments: list[str]) -> Parsed:
    """Options and inputs in order: --k v, --k=v, clustered short options, values stuck to them, -- before inputs."""
    out, queue = Parsed(), list(arguments)

    def add(definition, value):
        name, _, kind, takes = definition
        check_value(name, takes, value)
        if kind == GLOBAL:
            out.settings[name] = value
        out.ops.append(Op(name, value, kind))

    def following(flag):
        if not queue:
            raise ArgumentError(f"option {flag} requires a value")
        return queue.pop(0)

    while queue:
        arg = queue.pop(0)
        if arg == "--":
            out.ops += [Op("file", a, ACTION) for a in queue]
            break
        if arg.startswith("--"):
            name, equals, value = arg[2:].partition("=")
            if name not in LONG:
                raise ArgumentError(f"unknown option --{name}")
            takes = LONG[name][3]
            if takes == "none":
                if equals:
                    raise ArgumentError(f"option --{name} does not take a value")
                value = "true"
            elif takes == "optional":
                value = value if equals else queue.pop(0) if queue and not queue[0].startswith("-") else "true"
            elif not equals:
                value = following(f"--{name}")
            add(LONG[name], value)
        elif arg.startswith("-") and len(arg) > 1:
            rest = arg[1:]
            while rest:
                letter, rest = rest[0], rest[1:]
                if letter not in SHORT:
                    raise ArgumentError(f"unknown option -{letter}")
                takes = SHORT[letter][3]
                if takes == "none" or takes == "optional" and (not rest or rest[0] == letter):
                    add(SHORT[letter], "true")
                else:
                    add(SHORT[letter], rest or following(f"-{letter}"))
                    rest = ""
        else:
            out.ops.append(Op("file", arg, ACTION))
    return out


@dataclass(frozen=True)
class Render:
    """How a section's files are rendered."""

    head: int = -1
    tail: int = 0
    numbers: bool = False
    max_size: int = 0
    functions: bool = False
    types: bool = False
    documents: bool = False
    media: bool = False


@dataclass
class Item:
    """kind: file, stdin, tree, section, meta, prompt or prompt-file; a tree's `covers` are the places of its files."""

    kind: str
    value: str = ""
    tree_only: bool = False
    covers: tuple[int, ...] = ()


@dataclass
class Section:
    render: Render = field(default_factory=Render)
    options: Options = field(default_factory=Options)
    items: list[Item] = field(default_factory=list)


_FLAGS = {"line-numbers": "numbers", "functions": "functions", "types": "types", "documents": "documents", "media": "media"}
_WALK = {"expand": "expand", "hidden": "hidden", "follow": "follow", "no-links": "no_links", "no-ignore": "no_ignore"}


def with_option(section: Section, op: Op) -> Section:
    """A section with one more option: head resets tail, tail resets head, lines sets both; others only add."""
    render, options = section.render, section.options
    if op.name in ("head", "tail", "lines"):
        n = int(op.value)
        halves = {"head": (n, 0), "tail": (0, n), "lines": (int((n + 1) / 2), int(n / 2))}[op.name]
        render = replace(render, head=halves[0], tail=halves[1])
    elif op.name == "max-size":
        render = replace(render, max_size=size_of(op.value))
    elif op.name in _FLAGS:
        render = replace(render, **{_FLAGS[op.name]: True})
    elif op.name in _WALK:
        options = replace(options, **{_WALK[op.name]: True})
    else:
        rule: Rule = include(op.value) if op.name == "include" else exclude(op.value)
        options = replace(options, globs=(*options.globs, rule))
    return Section(render, options, section.items)


def item_of(op: Op) -> Item:
    if op.name == "file":
        return Item("stdin") if op.value == "-" else Item("file", op.value)
    return Item({"tree": "tree", "tree-only": "tree", "section": "section", "system-context": "meta", "prompt": "prompt", "prompt-file": "prompt-file"}[op.name], op.value, op.name == "tree-only")


def compile_sections(ops: list[Op]) -> tuple[list[Section], list[str]]:
    """Sections of items, and warnings.

    An option or -s after files starts a new section with default options.  Options that no file follows go back to
    the files before them; options before any file carry on into the next -s.
    """
    done: list[Section] = []
    warnings: list[str] = []
    now, waiting, after_files = Section(), [], False
    has_files = False
    for op in ops:
        if op.kind == SCOPED:
            if has_files:
                done.append(now)
                now, has_files, after_files = Section(), False, True
            now = with_option(now, op)
            waiting.append(op)
        elif op.kind == ACTION:
            item = item_of(op)
            if item.kind in ("file", "stdin"):
                has_files, after_files, waiting = True, False, []
            elif item.kind == "section":
                following = Section()
                if after_files:
                    done[-1] = _trailing(done[-1], waiting, warnings)
                    waiting = []
                elif not has_files:
                    following = Section(now.render, now.options)
                else:
                    waiting = []
                if now.items:
                    done.append(now)
                now, has_files, after_files = following, False, False
            now.items.append(item)
    if after_files:
        done[-1] = _trailing(done[-1], waiting, warnings)
    elif not has_files and waiting:
        warnings.append("options apply to no files: " + ", ".join(f"--{op.name}" for op in waiting))
    if now.items:
        done.append(now)
    for section in done:
        _cover(section, warnings)
    return done, warnings


def _trailing(section: Section, ops: list[Op], warnings: list[str]) -> Section:
    warnings.append("trailing options apply to the files before them: " + ", ".join(f"--{op.name}" for op in ops))
    for op in ops:
        section = with_option(section, op)
    return section


def _cover(section: Section, warnings: list[str]) -> None:
    """Each tree covers the files of its group: up to the next tree-only, or the section's end."""
    groups: list[list[int]] = [[]]
    for place, item in enumerate(section.items):
        if item.kind == "tree" and item.tree_only:
            groups.append([])
        groups[-1].append(place)
    for group in groups:
        members = [section.items[p] for p in group]
        files = tuple(p for p in group if section.items[p].kind in ("file", "stdin"))
        only = any(m.kind == "tree" and m.tree_only for m in members)
        if not files and any(m.kind == "tree" for m in members):
            warnings.append("a tree covers no files")
        for item in members:
            if item.kind == "tree":
                item.covers = files
            elif item.kind in ("file", "stdin"):
                item.tree_only = only
