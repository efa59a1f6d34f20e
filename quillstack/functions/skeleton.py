"""Code skeletons: the rows of a source text that declare functions and types, with their documentation.

Python is read by its own grammar.  Languages with braces go through a scanner: comments and strings are blanked out, a
block is split into declarations, each declaration is told by its header, and a type's members are looked at likewise.
Ruby, Haskell, OCaml and Objective-C are read by line.  A text that can't be read keeps all its rows.

Rows are half-open ranges (start, end, cut), counted from 0; a cut above 0 ends the range's last row at that column.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

Range = tuple[int, int, int]


@dataclass(frozen=True)
class Language:
    """What tells declarations apart.  `shown(header, owner)` says whether a declaration is visible."""

    types: str
    functions: str
    shown: Callable[[str, str], bool] = lambda header, owner: True
    by_line: bool = False
    comma: str = ""  # types whose members are parted by commas
    quotes: str = "\"'"
    triple: tuple[str, ...] = ()
    hash_comments: bool = False
    values: str = r"."  # members that count as values of a type


def _not(*words: str) -> Callable[[str, str], bool]:
    pattern = re.compile(rf"(?<![\w#])(?:{'|'.join(words)})\b")
    return lambda header, owner: not pattern.search(header.split("(")[0].split("=")[0])


def _needs(*words: str) -> Callable[[str, str], bool]:
    pattern = re.compile(rf"\b(?:{'|'.join(words)})\b")
    return lambda header, owner: bool(pattern.search(header.split("(")[0])) or bool(re.search(r"\b(interface|enum)\b", owner))


def _go(header: str, owner: str) -> bool:
    name = re.match(r"(?:func\s*(?:\([^)]*\)\s*)?|type\s+|\*?(?:\w+\.)?)(\w+)", header)
    return bool(name) and name[1][0].isupper()


def _rust(header: str, owner: str) -> bool:
    inherits = re.match(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:enum|trait)\b|(?:unsafe\s+)?impl\b[^{]*\bfor\b", owner)
    return bool(re.match(r"pub\b|impl\b|unsafe\s+impl\b|macro_rules", header)) or bool(inherits)


def _typescript(header: str, owner: str) -> bool:
    return not re.match(r"(?:[\w@]+\s+)*?private\b|#", header)


def _dart(header: str, owner: str) -> bool:
    name = re.search(r"([\w.]+)\s*(?:<[^(]*>)?\(", header) or re.search(r"\b(?:class|mixin|extension|enum|typedef)\s+(\w+)", header) or re.search(r"(\w+)\s*(?:=|$)", header)
    return not (name and name[1].split(".")[-1].startswith("_"))


CALL = r"[\w$~>\]]\s*(?:<[^()]*>\s*)?\("
_JS = dict(
    types=r"(?:export\s+|default\s+|declare\s+|abstract\s+)*(?:class|interface|enum|namespace|type)\b",
    functions=rf"(?:export\s+|default\s+|declare\s+)*(?:async\s+)?function\b|(?:export\s+)?(?:const|let|var)\s+\w+[^=]*=\s*(?:async\s*)?(?:\(|\w+\s*=>|function\b)|(?!if\b|for\b|while\b|switch\b|return\b|export\s+(?:const|let)|const\b|let\b|var\b)[^=]*?{CALL}",
    shown=_typescript, by_line=True, quotes="\"'`",
)
_C_TYPES = r"(?:typedef\b|(?:static\s+|const\s+|extern\s+)*(?:struct|union|enum)\b[^()=]*$)"
_C_FUNCTIONS = rf"(?!typedef|return|else|if\b|for\b|while\b|switch\b|using\b)[^=]*?{CALL}"
LANGUAGES: dict[str, Language] = {
    "go": Language(r"type\b", r"func\b|\w+\(", _go, by_line=True, quotes="\"'`"),
    "c": Language(_C_TYPES, _C_FUNCTIONS, _not("static")),
    "cpp": Language(r"(?:template\s*<[^{]*>\s*)?(?:class|namespace|typedef|using|struct|union|enum)\b", rf"(?:template\s*<[^{{]*>\s*)?{_C_FUNCTIONS}", _not("static_assert", "friend")),
    "java": Language(r"(?:@?[\w.]+\s+)*?(?:class|interface|enum|record|@interface)\s+\w", rf"[^=]*?{CALL}", _not("private"), triple=('"""',), comma="enum"),
    "csharp": Language(r"(?:\w+\s+)*?(?:class|interface|enum|record|struct|namespace)\s+[\w.]", rf"[^=]*?{CALL}", lambda h, o: _needs("public", "protected", "internal")(h, o) or h.startswith("namespace"), comma="enum"),
    "rust": Language(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|union|trait|impl|type)\b", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern)\s+)*fn\b", _rust, comma=r"struct|enum|union", quotes='"'),
    "typescript": Language(**_JS), "tsx": Language(**_JS), "javascript": Language(**_JS), "jsx": Language(**_JS),
    "kotlin": Language(r"(?:@?\w+\s+)*?(?:class|interface|object|typealias)\b", r"(?:\w+\s+)*?(?:fun|constructor|init)\b", _not("private"), by_line=True, triple=('"""',), comma="enum"),
    "swift": Language(r"(?:@?\w+\s+)*?(?:class|struct|enum|protocol|extension|actor|typealias)\s+(?!func\b|var\b)\w", r"(?:@?[\w()]+\s+)*?(?:func\b|init\b|deinit\b|subscript\b)", _not("private", "fileprivate"), by_line=True, triple=('"""',), quotes='"'),
    "scala": Language(r"(?:\w+\s+)*?(?:class|trait|object|type)\s+\w", r"(?:[\w\[\]]+\s+)*?def\b", _not("private"), by_line=True, triple=('"""',), quotes='"'),
    "php": Language(r"(?:\w+\s+)*?(?:class|interface|trait|enum)\s+\w", r"(?:\w+\s+)*?function\b", _not("private"), hash_comments=True),
    "dart": Language(r"(?:\w+\s+)*?(?:class|mixin|extension|enum|typedef)\s+\w", rf"[^=]*?{CALL}|.*=>", _dart, triple=('"""', "'''"), comma="enum"),
    "zig": Language(r"(?!)", r"(?:pub\s+)?(?:export\s+|extern\s+|inline\s+)*fn\b", lambda h, o: h.startswith("pub"), quotes='"'),
    "groovy": Language(r"(?:@?\w+\s+)*?(?:class|interface|enum|trait)\s+\w", rf"[^=]*?{CALL}", _not("private"), by_line=True, triple=('"""', "'''")),
}
LINE_LANGUAGES = ("python", "ruby", "haskell", "ocaml", "objectivec")
SUPPORTED = (*LANGUAGES, *LINE_LANGUAGES)


def blanked(text: str, lang: Language) -> tuple[str, set[int], list[tuple[int, int]]]:
    """The text with comments and strings as blanks, rows that hold only comments, and (start, end) of comments."""
    out, comments, i, n = list(text), [], 0, len(text)

    def wipe(a: int, b: int):
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if text.startswith("//", i) or lang.hash_comments and c == "#" and not text.startswith("#[", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            comments.append((i, end))
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            comments.append((i, end))
        elif quote := next((q for q in lang.triple if text.startswith(q, i)), None):
            end = text.find(quote, i + 3)
            end = n if end < 0 else end + 3
        elif m := re.compile(r'R"([^()\\\s]{0,16})\(').match(text, i):
            end = text.find(f'){m[1]}"', i)
            end = n if end < 0 else end + len(m[1]) + 2
        elif c in lang.quotes:
            end = i + 1
            while end < n and text[end] != c and (text[end] != "\n" or c == "`"):
                end += 2 if text[end] == "\\" else 1
            end = min(n, end + 1)
            wipe(i + 1, end - 1)
            i = end
            continue
        elif lang.quotes == '"' and (m := re.compile(r"'(?:\\.[^']{0,8}|[^'\\])'").match(text, i)):  # a character, not a lifetime
            end = m.end()
        else:
            i += 1
            continue
        wipe(i, end)
        i = end
    mask, only, at = "".join(out), set(), 0
    for row, line in enumerate(text.split("\n")):
        if line.strip() and not mask[at : at + len(line)].strip():
            only.add(row)
        at += len(line) + 1
    return mask, only, comments


@dataclass
class Item:
    start: int
    body: tuple[int, int] | None  # between the braces
    end: int
    header: str


_OPEN, _CLOSE = "([{", ")]}"
_GOES_ON = re.compile(r"\s*(?:[.:=,?|&+*){]|->|=>|extends\b|implements\b|with\b|where\b|throws\b|else\b|derives\b)")


def items(mask: str, start: int, end: int, lang: Language, commas: bool = False) -> list[Item]:
    """The declarations between two positions."""
    out, i = [], start
    while i < end:
        if mask[i] in " \t\r\n;,":
            i += 1
            continue
        if mask[i] == "#" and lang.functions is LANGUAGES["c"].functions or mask[i] == "#" and lang is LANGUAGES["cpp"]:
            while i < end and mask[i] != "\n":  # a directive, with continued lines
                i += 2 if mask[i] == "\\" else 1
            continue
        begin, depth, body, k, assigned = i, 0, None, i, False
        while k < end:
            c = mask[k]
            if c in _OPEN:
                if c == "{" and depth == 0 and body is None:
                    close = _match(mask, k, end)
                    body = (k + 1, close)
                    k = close
                    tail = mask[close + 1 : end]
                    if not assigned and not re.match(r"\s*(?:[\w*\s,]*;)" if re.match(r"typedef|struct|union|enum", mask[begin:k]) else r"[ \t]*;", tail):
                        k += 1
                        break
                else:
                    depth += 1
            elif c in _CLOSE:
                depth -= 1
                if depth < 0:
                    break
            elif depth == 0:
                if c == ";" or commas and c == ",":
                    k += 1
                    break
                if c == "=" and mask[k + 1] not in "=>" and mask[k - 1] not in "=!<>":
                    assigned = True
                if c == "\n" and lang.by_line:
                    line = mask[mask.rfind("\n", 0, k) + 1 : k].rstrip()
                    attribute = re.fullmatch(r"\s*(?:@[\w.]+(?:\(.*\))?\s*)+", line)
                    if not attribute and not re.search(r"(?:[,=+\-*/&|<(\[{:?]|=>|->)$", line) and not _GOES_ON.match(mask[k:end]):
                        break
            k += 1
        header = " ".join(mask[begin : body[0] - 1 if body else k].split()).rstrip(";, ")
        out.append(Item(begin, body, min(k, end), re.sub(r"^(?:(?:@(?!interface)[\w.]+(?:\s*\([^()]*\))?|#!?\[[^\]]*\]|\[[^\]]*\])\s*)+", "", header)))
        i = max(k, begin + 1)
    return out


def _match(mask: str, at: int, end: int) -> int:
    depth = 0
    for k in range(at, end):
        if mask[k] == "{":
            depth += 1
        elif mask[k] == "}":
            depth -= 1
            if not depth:
                return k
    raise ValueError("unclosed brace")


class _Braces:
    def __init__(self, name: str, text: str, functions: bool, types: bool):
        self.lang, self.text = LANGUAGES[name], text
        self.name, self.functions, self.wants_types = name, functions, types
        self.mask, self.comment_rows, _ = blanked(text, self.lang)
        if name == "php":
            self.mask = re.sub(r"<\?(?:php|=)?|\?>", lambda m: " " * len(m[0]), self.mask)
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        if self.mask.count("{") != self.mask.count("}"):
            raise ValueError("unbalanced braces")

    def row(self, at: int) -> int:
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        return lo

    def docs(self, row: int) -> int:
        """First row of the comment rows right above a row."""
        while row - 1 in self.comment_rows:
            row -= 1
        return row

    def signature(self, item: Item) -> Range:
        """From documentation through the row where the body opens; a body that closes there is cut off."""
        first = self.docs(self.row(item.start))
        if item.body is None:
            return first, self.row(max(item.start, item.end - 1)) + 1, 0
        opened = item.body[0] - 1
        last = self.row(opened)
        one_line = self.row(item.body[1]) == last
        return first, last + 1, opened + 1 - self.starts[last] if one_line else 0

    def whole(self, item: Item) -> Range:
        return self.docs(self.row(item.start)), self.row(max(item.start, item.end - 1)) + 1, 0

    def is_type(self, header: str) -> bool:
        return re.match(self.lang.types, header) is not None

    def is_function(self, item: Item, owner: str = "") -> bool:
        if owner and self.name == "go" and not owner.split("struct")[0].endswith("interface") and "interface" not in owner:
            return False
        return re.match(self.lang.functions, item.header) is not None

    def block(self, start: int, end: int, owner: str, out: list[Range], commas: bool = False) -> bool:
        """Adds a block's declarations; whether one was kept."""
        kept, access = False, not re.match(r"(?:template\s*<[^{]*>\s*)?class\b", owner) or self.name != "cpp"
        for item in items(self.mask, start, end, self.lang, commas):
            if self.name == "cpp" and (m := re.match(r"(public|private|protected)\s*:(?!:)\s*", item.header)):
                access = m[1] != "private"
                label, item.start = item.start, item.start + re.match(r"\w+\s*:\s*", self.mask[item.start :]).end()
                item.header = item.header[m.end() :]
                if access and owner:
                    out.append((self.row(label), self.row(label) + 1, 0))
                if not item.header:
                    continue
            if self.name in ("typescript", "javascript", "tsx", "jsx", "kotlin", "scala") and re.match(r"import\b|package\b", item.header):
                continue
            if not access or not self.lang.shown(item.header, owner):
                continue
            if self.is_type(item.header):
                kept |= self.type(item, out)
            elif self.is_function(item, owner):
                if self.functions:
                    out.append(self.signature(item))
                    kept = True
            elif owner and self.wants_types and item.header and not re.match(r"namespace\b", owner):
                out.append(self.whole(item) if item.body is None or self.row(item.body[1]) == self.row(item.start) else self.signature(item))
                kept = True
        return kept

    def type(self, item: Item, out: list[Range]) -> bool:
        if item.body is None:
            if self.wants_types:
                out.append(self.whole(item))
            return self.wants_types
        members: list[Range] = []
        commas = bool(self.lang.comma) and re.search(rf"\b(?:{self.lang.comma})\b", item.header) is not None
        kept = self.block(*item.body, item.header, members, commas)
        if not kept and not self.wants_types:
            return False
        first, last, cut = self.signature(item)
        close = self.row(max(item.body[1], item.end - 1))
        if re.match(r"namespace\b", item.header) and not kept:
            return False
        if cut:
            out.append((first, close + 1, 0))
        else:
            out.extend([(first, last, 0), *members, (self.row(item.body[1]), close + 1, 0)])
        return True

    def ranges(self) -> list[Range]:
        out: list[Range] = []
        self.block(0, len(self.mask), "", out)
        return out


# By grammar and by line


def _python(text: str, functions: bool, types: bool) -> list[Range]:
    """Public functions, classes with their public members, docstrings, decorators and comment rows right above."""
    lines = text.split("\n")
    out: list[Range] = []
    public = lambda name: not name.startswith("_") or name.startswith("__") and name.endswith("__")

    def top(node) -> int:
        row = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
        while row and lines[row - 1].strip().startswith("#"):
            row -= 1
        return row

    def header(node) -> int:
        """Rows through the signature and the docstring."""
        first = node.body[0]
        doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        if doc:
            return first.end_lineno
        row = first.lineno - 1
        if isinstance(first, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            row = top(first)
        inside = [n.end_lineno for n in ast.walk(node.args)  if hasattr(n, "end_lineno")] if hasattr(node, "args") else []
        inside += [n.end_lineno for n in (getattr(node, "returns", None), *getattr(node, "bases", [])) if n is not None]
        end = max([node.lineno, *inside])
        while end <= row and not re.search(r":\s*(?:#.*)?$", lines[end - 1]):
            end += 1
        return min(end, max(row, node.lineno))

    def function(node):
        first, end = top(node), header(node)
        body = node.body[0]
        cut = 0
        if body.lineno == end and not isinstance(body, ast.Expr) or body.lineno == node.lineno:
            cut = len(lines[end - 1][: body.col_offset].rstrip())
        out.append((first, end, cut))

    def walk(nodes, owner: bool) -> bool:
        kept = False
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if functions and public(node.name):
                    function(node)
                    kept = True
            elif isinstance(node, ast.ClassDef) and public(node.name):
                at = len(out)
                out.append((top(node), header(node), 0))
                inner = walk(node.body, True)
                if not inner and not types:
                    del out[at:]
                kept |= inner or types
            elif owner and types and isinstance(node, (ast.Assign, ast.AnnAssign)):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if isinstance(target, ast.Name) and public(target.id):
                    first = node.lineno - 1
                    while first and lines[first - 1].strip().startswith("#"):
                        first -= 1
                    out.append((first, node.end_lineno, 0))
                    kept = True
        return kept

    walk(ast.parse(text).body, False)
    return out


def _above(lines: list[str], row: int, mark: str) -> int:
    while row and re.match(mark, lines[row - 1]):
        row -= 1
    return row


def _ruby(text: str, functions: bool, types: bool) -> list[Range]:
    """Classes, modules and methods down to a bare private or protected; `end` rows match by indentation."""
    lines, out = text.split("\n"), []
    stack: list[list] = []  # indentation, place in out, kept, hidden
    for row, line in enumerate(lines):
        indent = len(line) - len(line.lstrip())
        word = line.strip()
        if re.match(r"(class|module)\b", word):
            stack.append([indent, len(out), False, False])
            out.append((_above(lines, row, r"\s*#"), row + 1, 0))
        elif stack and word == "end" and indent == stack[-1][0]:
            _, at, kept, _ = stack.pop()
            if kept or types:
                out.append((row, row + 1, 0))
                if stack:
                    stack[-1][2] = True
            else:
                del out[at:]
        elif re.fullmatch(r"(private|protected)", word) and stack:
            stack[-1][3] = True
        elif re.fullmatch("public", word) and stack:
            stack[-1][3] = False
        elif re.match(r"def\b", word):
            if functions and not (stack and stack[-1][3]):
                end = row
                while lines[end].count("(") and end + 1 < len(lines) and "".join(lines[row : end + 1]).count("(") > "".join(lines[row : end + 1]).count(")"):
                    end += 1
                out.append((_above(lines, row, r"\s*#"), end + 1, 0))
                if stack:
                    stack[-1][2] = True
        elif types and stack and not stack[-1][3] and re.match(r"(attr_\w+|[A-Z]\w*\s*=)", word) and indent > stack[-1][0]:
            out.append((_above(lines, row, r"\s*#"), row + 1, 0))
            stack[-1][2] = True
    return out


def _rows(lines: list[str], row: int) -> int:
    """The row after a declaration that goes on in indented rows."""
    end = row + 1
    while end < len(lines) and re.match(r"\s+\S", lines[end]) and not re.match(r"\s*(--|\(\*)", lines[end]):
        end += 1
    return end


def _haskell(text: str, functions: bool, types: bool) -> list[Range]:
    """Signatures of functions; data, newtype, type, class and instance declarations."""
    lines, out = text.split("\n"), []
    for row, line in enumerate(lines):
        if functions and re.match(r"(?:[a-z_][\w']*|\([^)]*\))\s*(?:,\s*[a-z_][\w']*\s*)*::", line):
            out.append((_above(lines, row, r"\s*--"), _rows(lines, row), 0))
        elif types and re.match(r"(data|newtype|type|class|instance)\b", line):
            out.append((_above(lines, row, r"\s*--"), _rows(lines, row), 0))
    return out


def _ocaml(text: str, functions: bool, types: bool) -> list[Range]:
    """Functions (let with parameters, or fun) through their equals sign; types, exceptions and module headers."""
    lines, out = text.split("\n"), []
    mark = r"\s*\(\*.*\*\)\s*$"
    for row, line in enumerate(lines):
        if functions and re.match(r"let\s+(?:rec\s+)?[a-z_][\w']*\s+(?!:)[^=\s:]|let\s+(?:rec\s+)?[a-z_][\w']*\s*(?::[^=]*)?=\s*(?:fun|function)\b", line) or functions and re.match(r"\s*val\s+\w+\s*:.*->", line):
            end = row
            while "=" not in lines[end] and end + 1 < len(lines) and lines[end].strip() and not line.lstrip().startswith("val"):
                end += 1
            out.append((_above(lines, row, mark), end + 1, 0))
        elif types and re.match(r"(type|exception|module|class|and)\b", line):
            end = _rows(lines, row)
            while end < len(lines) and re.match(r"[}\]|]", lines[end]):
                end += 1
            out.append((_above(lines, row, mark), end, 0))
    return out


def _objectivec(text: str, functions: bool, types: bool) -> list[Range]:
    """Interfaces and protocols with properties and methods, methods of implementations, C functions."""
    lines, out = text.split("\n"), []
    hidden, inside, at, kept = False, False, 0, False
    for row, line in enumerate(lines):
        word = line.strip()
        first = _above(lines, row, r"\s*(//|/?\*)")
        if re.match(r"@(interface|protocol|implementation)\b", word):
            inside, hidden, at, kept = True, False, len(out), False
            out.append((first, row + 1, 0))
        elif word == "@end" and inside:
            out.append((row, row + 1, 0))
            if not kept and not types:
                del out[at:]
            inside = False
        elif re.match(r"@(private|package)\b", word):
            hidden = True
        elif re.match(r"@(public|protected)\b", word):
            hidden = False
        elif re.match(r"[-+]\s*\(", word) or not inside and re.match(r"[A-Za-z_][\w\s*]*\([^;]*\)\s*\{", word):
            if functions:
                end = row
                while not re.search(r"[;{]\s*(//.*)?$", lines[end]) and end + 1 < len(lines):
                    end += 1
                out.append((first, end + 1, 0))
                kept = True
        elif types and inside and not hidden and (word.startswith("@property") or re.match(r"[A-Za-z_][\w\s*<>]*;", word)):
            out.append((first, row + 1, 0))
            kept = True
    return out


BY_LINE = {"python": _python, "ruby": _ruby, "haskell": _haskell, "ocaml": _ocaml, "objectivec": _objectivec}


def merged(ranges: list[Range]) -> list[Range]:
    """Ranges in order, joined where they overlap or touch; a cut row that another range holds whole isn't cut."""
    out: list[Range] = []
    for start, end, cut in sorted(ranges):
        if out and start <= out[-1][1] and not out[-1][2]:
            a, b, _ = out[-1]
            out[-1] = (a, max(b, end), cut if end > b else 0)
        elif out and start < out[-1][1]:
            a, b, old = out[-1]
            out[-1] = (a, max(b, end), cut if end > b else old if cut and end == b else 0)
        else:
            out.append((start, end, cut))
    return out


def skeleton_rows(language: str, text: str, functions: bool, types: bool, path: str = "") -> list[Range] | None:
    """The rows to keep; None (all) for no option, an unknown language or a text that can't be read."""
    if language not in SUPPORTED or not (functions or types):
        return None
    if language == "c" and path.lower().endswith(".h") and re.search(r"^\s*(?:class|namespace|template|using)\b|^\s*(?:public|private|protected)\s*:", text, re.M):
        language = "cpp"
    try:
        found = BY_LINE[language](text, functions, types) if language in BY_LINE else _Braces(language, text, functions, types).ranges()
    except (ValueError, SyntaxError, RecursionError, IndexError):
        return None
    return merged(found)


def skeleton_lines(ranges: list[Range], lines: list[str]) -> list[tuple[int, str]]:
    """(row from 1, text) of the kept rows; row 0 is a marker where rows were left out between kept ones."""
    out: list[tuple[int, str]] = []
    before = None
    for start, end, cut in ranges:
        for row in range(start, min(end, len(lines))):
            if before is not None and (row != before[0] + 1 or before[1]):
                out.append((0, "..."))
            last = row == end - 1
            out.append((row + 1, lines[row][:cut] if last and cut else lines[row]))
            before = (row, bool(last and cut))
    return out


def skeleton_text(language: str, text: str, functions: bool = True, types: bool = True, path: str = "") -> str:
    """The kept rows with markers between, each ended by a line break; the text itself if nothing is to be reduced."""
    ranges = skeleton_rows(language, text, functions, types, path)
    if ranges is None:
        return text
    lines = text.removesuffix("\n").split("\n")
    return "".join(line + "\n" for _, line in skeleton_lines(ranges, lines))


def mode_label(functions: bool, types: bool) -> str:
    return "definitions" if functions and types else "function signatures" if functions else "type definitions" if types else ""


def skeletons(files: DataFrame, functions: bool = True, types: bool = True, language: str = "language", content: str = "text") -> DataFrame:
    """Adds skeleton (text) and skeleton_mode; null where nothing is reduced."""

    def run(batches):
        for batch in batches:
            texts, modes = [], []
            paths = batch.column("path").to_pylist() if "path" in batch.schema.names else [""] * batch.num_rows
            for name, t, path in zip(batch.column(language).to_pylist(), batch.column(content).to_pylist(), paths):
                reduced = t is not None and skeleton_rows(name, t, functions, types, path or "") is not None
                texts.append(skeleton_text(name, t, functions, types, path or "") if reduced else None)
                modes.append(mode_label(functions, types) if reduced else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(modes, pa.string())], [*batch.schema.names, "skeleton", "skeleton_mode"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("skeleton", StringType()), StructField("skeleton_mode", StringType())]))
