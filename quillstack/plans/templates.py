"""User templates: a subset of Go's text/template, parsed and checked before anything is rendered.

Supported: fields, variables, literals, pipelines, parentheses, if / else if / else, with, range, template, comments and
trim markers; the usual comparison and logic functions, printf, len and index, and the engine's own text functions.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from datetime import datetime

# Fields of the contexts that templates see.
PLAN = dict.fromkeys(("TotalFiles", "TotalSize", "SizeUnknown", "TokenEstimate", "TotalSections", "SkippedBySize"))
SECTION = dict.fromkeys(("Body", "Index", "TotalFiles", "TotalSize", "IsImplicit")) | {"Global": PLAN}
FILE = dict.fromkeys(
    ("Path", "AbsPath", "Archive", "Entry", "Size", "OriginalSize", "ModTime", "TotalRows", "ReadError", "IsError", "IsEstimate", "Language", "Content", "IsBinary", "IsImage", "DataURI", "IsCompactView", "FileIndex", "SectionFileIndex", "SkeletonMode", "ConvertedFrom", "TokenEstimate")
) | {"Global": PLAN, "Section": SECTION}
BODY = {"Body": None, "Global": PLAN, "Section": SECTION}
REPORT = PLAN | dict.fromkeys(("TotalWrittenBytes", "TotalRows", "WrittenTokenEstimate", "BinaryFiles", "FailedFiles"))
CONTEXTS = {
    "file_content": FILE, "file_error": FILE, "file_binary": FILE, "file_compact": FILE, "file_header": FILE, "file_image": FILE,
    "section": SECTION, "prompt": BODY, "tree": BODY, "meta": BODY | {"Fields": ...}, "section_header": SECTION, "section_footer": SECTION,
    "output_header": {"Global": PLAN}, "output_footer": {"Global": PLAN}, "stats": {"Global": REPORT, "ColorEnabled": None},
}


# Partials that file templates may call where a configuration has none of its own.
DEFAULT_PARTIALS = {
    "file_header": "{{ if gt .Section.TotalFiles 1 }}[{{ .SectionFileIndex }}/{{ .Section.TotalFiles }}] {{ end }}{{ .Path }}",
    "file_binary": "{{ .Path }} - binary file skipped ({{ .Size | humanize }})",
    "file_content": "{{ .Content | endNewline }}",
}


class TemplateError(ValueError):
    pass


def humanize(n: int) -> str:
    if n < 1000:
        return f"{n} B"
    power = min(4, (len(str(n)) - 1) // 3)
    return f"{n / 1000 ** ((len(str(n)) - 1) // 3):.1f} {('kB', 'MB', 'GB', 'TB')[power - 1]}"


def go_date(layout: str, moment: datetime | None) -> str:
    """A time in a layout written by the reference time Mon Jan 2 15:04:05 2006."""
    parts = {"2006": "%Y", "January": "%B", "Monday": "%A", "Jan": "%b", "Mon": "%a", "01": "%m", "02": "%d", "15": "%H", "03": "%I", "04": "%M", "05": "%S", "06": "%y", "PM": "%p", "-0700": "%z", "MST": "%Z"}
    return "" if moment is None else re.sub("|".join(sorted(parts, key=len, reverse=True)), lambda m: moment.strftime(parts[m[0]]), layout)


def _escape(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = text.replace(plain, entity)
    return text


def _data_uri(path: str) -> str:
    if not path:
        raise TemplateError("dataURI: empty path")
    from ..functions.names import FORMATS

    mime = FORMATS.get(os.path.splitext(path)[1][1:].lower(), (0, 0, "application/octet-stream"))[2]
    try:
        with open(path, "rb") as f:
            return f"data:{mime};base64,{base64.b64encode(f.read()).decode()}"
    except OSError:
        return ""


def _shown(value) -> str:
    return {True: "true", False: "false", None: "<no value>"}.get(value, value) if value is None or isinstance(value, bool) else str(value)


def _printf(form: str, *args) -> str:
    form = re.sub(r"%[vs]", "%s", form)
    form = form.replace("%q", '"%s"').replace("%t", "%s")
    try:
        return form % tuple(_shown(a) if isinstance(a, bool) else a for a in args)
    except (TypeError, ValueError) as error:
        raise TemplateError(f"printf: {error}") from error


def _and(*args):
    return next((a for a in args if not a), args[-1])


def _or(*args):
    return next((a for a in args if a), args[-1])


FUNCTIONS: dict[str, Callable] = {
    "and": _and, "or": _or, "not": lambda a: not a, "eq": lambda a, *b: a in b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "len": len, "index": lambda a, i: a[i], "printf": _printf,
    "print": lambda *a: "".join(map(_shown, a)), "humanize": humanize, "commafy": lambda n: f"{n:,}", "plural": lambda n, one, many: one if n == 1 else many,
    "escape": _escape, "endNewline": lambda s: s + "\n" if s and not s.endswith("\n") else s, "date": go_date, "dataURI": _data_uri,
}
_COLORS = {"accent": "36", "dim": "2"}
STATS_FUNCTIONS = {name: lambda on, s, code=code: f"\x1b[{code}m{s}\x1b[0m" if on else s for name, code in _COLORS.items()} | {
    "tokenLabel": lambda n, on: (f"\x1b[{31 if n >= 200_000 else 33 if n >= 128_000 else 32};1m~{n:,} tokens\x1b[0m" if on else f"~{n:,} tokens")
}
_WORD = re.compile(r'\s*(?:("(?:\\.|[^"\\])*")|(`[^`]*`)|(\$?[A-Za-z_]\w*(?:\.\w+)*|\$(?:\.\w+)*)|((?:\.\w+)+|\.)|(-?\d+(?:\.\d+)?)|(:=|[()|=]))')


def _words(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _WORD.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:].strip()[:20]!r}")
        kind = ("string", "raw", "name", "field", "number", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class Template:
    """A compiled template; call it with a context mapping."""

    def __init__(self, source: str, schema: dict | None = None, partials: dict[str, str] | None = None, functions: dict | None = None, name: str = "template"):
        self.functions = FUNCTIONS | (functions or {})
        self.schema, self.name = schema, name
        try:
            self.partials = {k: self._parse(v) for k, v in (partials or {}).items()}
            self.body = self._parse(source)
        except TemplateError as error:
            raise TemplateError(f"{name}: {error}") from error

    # Parsing

    def _parse(self, source: str) -> list:
        tokens: list[tuple[str, str]] = []
        at, trim = 0, False
        for m in re.finditer(r"\{\{(- )?(\s*/\*.*?\*/\s*|.*?)( -)?\}\}", source, re.S):
            text = source[at : m.start()]
            text = text.lstrip() if trim else text
            tokens.append(("text", text.rstrip() if m[1] else text))
            if not m[2].strip().startswith("/*"):
                tokens.append(("action", m[2].strip()))
            at, trim = m.end(), bool(m[3])
        if "{{" in source[at:]:
            raise TemplateError("unclosed action")
        tokens.append(("text", source[at:].lstrip() if trim else source[at:]))
        nodes, rest, _ = self._block(tokens, 0, top=True)
        return nodes

    def _block(self, tokens, i, top=False):
        """Nodes up to an else or end, what follows, and the action that ended them."""
        nodes = []
        while i < len(tokens):
            kind, text = tokens[i]
            i += 1
            if kind == "text":
                if text:
                    nodes.append(("text", text))
                continue
            word = text.split(None, 1)[0] if text else ""
            if word in ("end", "else"):
                if top:
                    raise TemplateError(f"unexpected {word}")
                return nodes, i, text
            if word in ("if", "with", "range"):
                node, i = self._branch(word, text[len(word) :], tokens, i)
                nodes.append(node)
            elif word == "template":
                parts = _words(text[len(word) :])
                if not parts or parts[0][0] != "string":
                    raise TemplateError("template needs a name")
                nodes.append(("template", parts[0][1][1:-1], self._pipeline(parts[1:]) if parts[1:] else None))
            else:
                words = _words(text)
                if len(words) > 2 and words[0][0] == "name" and words[0][1].startswith("$") and words[1][1] in (":=", "="):
                    nodes.append(("set", words[0][1], self._pipeline(words[2:])))
                else:
                    nodes.append(("show", self._pipeline(words)))
        if not top:
            raise TemplateError("missing end")
        return nodes, i, ""

    def _branch(self, word, text, tokens, i):
        condition = self._pipeline(_words(text))
        outer = self.schema
        if word in ("with", "range"):
            self.schema = None  # the dot is another one there
        then, i, ended = self._block(tokens, i)
        self.schema = outer
        other = []
        if ended.startswith("else"):
            rest = ended[4:].strip()
            if rest.startswith("if"):
                node, i = self._branch("if", rest[2:], tokens, i)
                return (word, condition, then, [node]), i
            other, i, ended = self._block(tokens, i)
            if ended.startswith("else"):
                raise TemplateError("else after else")
        return (word, condition, then, other), i

    def _pipeline(self, words):
        if not words:
            raise TemplateError("missing value")
        commands, now, depth = [], [], 0
        for w in words:
            depth += (w[1] == "(" and w[0] == "sign") - (w[1] == ")" and w[0] == "sign")
            if w == ("sign", "|") and not depth:
                commands.append(self._command(now))
                now = []
            else:
                now.append(w)
        return [*commands, self._command(now)]

    def _command(self, words):
        terms, i = [], 0
        while i < len(words):
            kind, text = words[i]
            if (kind, text) == ("sign", "("):
                depth, j = 1, i + 1
                while j < len(words) and depth:
                    depth += (words[j] == ("sign", "(")) - (words[j] == ("sign", ")"))
                    j += 1
                if depth:
                    raise TemplateError("unclosed (")
                terms.append(("pipe", self._pipeline(words[i + 1 : j - 1])))
                i = j
                continue
            if kind == "string":
                terms.append(("value", bytes(text[1:-1], "utf-8").decode("unicode_escape") if "\\" in text else text[1:-1]))
            elif kind == "raw":
                terms.append(("value", text[1:-1]))
            elif kind == "number":
                terms.append(("value", float(text) if "." in text else int(text)))
            elif kind == "field":
                path = [p for p in text.split(".") if p]
                self._check(path)
                terms.append(("field", path))
            elif kind == "name" and text in ("true", "false", "nil"):
                terms.append(("value", {"true": True, "false": False, "nil": None}[text]))
            elif kind == "name" and text.startswith("$"):
                name, *path = text.split(".")
                terms.append(("variable", name, path))
            elif kind == "name":
                if text not in self.functions:
                    raise TemplateError(f"function {text!r} not defined")
                terms.append(("call", text))
            else:
                raise TemplateError(f"unexpected {text!r}")
            i += 1
        if not terms:
            raise TemplateError("missing value")
        return terms

    def _check(self, path):
        """Fields of the dot outside with and range are known; those inside are checked when they run."""
        at = self.schema
        for name in path:
            if at is None or at is ...:
                return
            if name not in at:
                raise TemplateError(f"can't evaluate field {name}")
            at = at[name]

    # Rendering

    def __call__(self, context: dict) -> str:
        out: list[str] = []
        try:
            self._run(self.body, context, {"$": context}, out)
        except (TypeError, KeyError, IndexError, AttributeError) as error:
            raise TemplateError(f"{self.name}: {error}") from error
        return "".join(out)

    def _run(self, nodes, dot, variables, out):
        for node in nodes:
            kind = node[0]
            if kind == "text":
                out.append(node[1])
            elif kind == "show":
                out.append(_shown(self._value(node[1], dot, variables)))
            elif kind == "set":
                variables[node[1]] = self._value(node[2], dot, variables)
            elif kind == "if":
                self._run(node[2] if self._value(node[1], dot, variables) else node[3], dot, variables, out)
            elif kind == "with":
                value = self._value(node[1], dot, variables)
                self._run(node[2], value, variables, out) if value else self._run(node[3], dot, variables, out)
            elif kind == "range":
                value = self._value(node[1], dot, variables)
                members = [value[k] for k in sorted(value)] if isinstance(value, dict) else list(value or ())
                for member in members:
                    self._run(node[2], member, variables, out)
                if not members:
                    self._run(node[3], dot, variables, out)
            else:
                if node[1] not in self.partials:
                    raise TemplateError(f"template {node[1]!r} not defined")
                inner = self._value(node[2], dot, variables) if node[2] else None
                self._run(self.partials[node[1]], inner, {"$": inner}, out)

    def _value(self, pipeline, dot, variables):
        given = ()
        for terms in pipeline:
            if terms[0][0] == "call":
                args = [self._term(t, dot, variables) for t in terms[1:]]
                value = self.functions[terms[0][1]](*args, *given)
            else:
                value = self._term(terms[0], dot, variables)
            given = (value,)
        return given[0]

    def _term(self, term, dot, variables):
        kind = term[0]
        if kind == "value":
            return term[1]
        if kind == "pipe":
            return self._value(term[1], dot, variables)
        if kind == "call":
            return self.functions[term[1]]()
        value = dot
        path = term[1]
        if kind == "variable":
            if term[1] not in variables:
                raise TemplateError(f"undefined variable {term[1]}")
            value, path = variables[term[1]], term[2]
        for name in path:
            value = value[name]
        return value


def compile_templates(config: dict[str, str]) -> dict[str, Template]:
    """The templates of a configuration (keys like file_content_template), checked against their contexts."""
    sources = {k.removesuffix("_template"): v for k, v in config.items() if k.endswith("_template") and v}
    unknown = set(sources) - set(CONTEXTS)
    if unknown:
        raise TemplateError(f"unknown template {sorted(unknown)[0]!r}")
    partials = DEFAULT_PARTIALS | {k: sources[k] for k in ("file_header", "file_content", "file_binary") if k in sources}
    own = lambda k: {p: s for p, s in partials.items() if p != k} if k.startswith("file_") else {}
    return {k: Template(v, CONTEXTS[k], own(k), STATS_FUNCTIONS if k == "stats" else None, k) for k, v in sources.items()}
