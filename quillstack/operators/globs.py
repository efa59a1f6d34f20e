"""Ordered glob and ignore rules over paths, as Column expressions.

A rule set is compiled on the driver to regular expressions.  The last rule that matches decides, so a set becomes one
CASE expression in reverse order: no join, no shuffle.  A file is gone if a directory above it is excluded, which is
judged on every prefix of its path with higher-order functions.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("*?[{\\")


class GlobError(ValueError):
    """A glob with an unclosed bracket or brace, or a dangling backslash."""


def glob_regex(glob: str) -> str:
    """The regular expression of a whole glob; raises GlobError if it can't be parsed."""
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        at_start = i == 0 or glob[i - 1] == "/" or depth and glob[i - 1] in "{,"
        if c == "*":
            stars = len(glob[i:]) - len(glob[i:].lstrip("*"))
            end = i + stars
            if stars >= 2 and at_start and (end == n or glob[end] == "/" or depth and glob[end] in ",}"):
                if end < n and glob[end] == "/":
                    out.append("(?:[^/]*/)*")
                    end += 1
                elif out and out[-1] == "/":
                    out[-1] = "(?:/.*)?"
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            i = end
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            j = i + 1
            if j < n and glob[j] in "^!":
                j += 1
            first = j
            body = ""
            while j < n and (glob[j] != "]" or j == first):
                if glob[j] == "\\":
                    j += 1
                    if j == n:
                        raise GlobError(glob)
                    body += re.escape(glob[j])
                else:
                    body += glob[j] if glob[j] == "-" else re.escape(glob[j])
                j += 1
            if j >= n:
                raise GlobError(glob)
            inverted = first > i + 1
            out.append(f"[^/{body}]" if inverted else f"(?!/)[{body}]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise GlobError(glob)
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i == n:
                raise GlobError(glob)
            out.append(re.escape(glob[i]))
        else:
            out.append(c if c == "/" else re.escape(c))
        i += 1
    if depth:
        raise GlobError(glob)
    return "(?s)^" + "".join(out) + "$"


def alternatives(glob: str, most: int = 64) -> list[str] | None:
    """The globs without braces that a glob stands for; None if there are more than `most`, or a brace is never closed."""
    done, todo = [], [glob]
    while todo:
        if len(done) + len(todo) > most:
            return None
        text, depth, starts, i, bracket = todo.pop(), 0, [], 0, False
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif bracket:
                bracket = c != "]"
            elif c == "[":
                bracket = True
                i += 1 + (text[i + 1 : i + 2] in ("^", "!") and text[i + 1 : i + 2] != "")  # a bracket in first place is a member
            elif c == "{":
                depth += 1
                if depth == 1:
                    starts = [i]
            elif c == "," and depth == 1 or c == "}" and depth:
                if c == "}":
                    depth -= 1
                if c == "," or not depth:
                    starts.append(i)
                if not depth:
                    todo += [text[: starts[0]] + text[a + 1 : b] + text[i + 1 :] for a, b in zip(starts, starts[1:])]
                    break
            i += 1
        else:
            if depth:
                return None
            done.append(text)
    return done


@dataclass(frozen=True)
class Rule:
    """One compiled rule.  `keep` keeps what it matches instead of excluding it."""

    pattern: str
    keep: bool
    base: str = ""
    whitelist: bool = False

    @property
    def dirs_only(self) -> bool:
        return self.pattern.endswith("/")

    @property
    def body(self) -> str:
        text = self.pattern.removesuffix("/").removeprefix("/")
        return text[:-3] + "/*/**" if text.endswith("/**") else text

    @property
    def whole_path(self) -> bool:
        return "/" in self.body or self.pattern.removesuffix("/").startswith("/")

    def regex(self) -> str | None:
        """None for a glob that can't be parsed: it matches nothing."""
        if not _SPECIAL & set(self.body):
            return "(?s)^" + re.escape(self.body) + "$"
        try:
            return glob_regex(self.body)
        except GlobError:
            return None

    def matches(self, path: str, is_dir: bool) -> bool:
        """The rule on the driver, for single paths."""
        if self.dirs_only and not is_dir or (regex := self.regex()) is None:
            return False
        if self.base and self.base != ".":
            if path == self.base:
                path = "."
            elif path.startswith(above := self.base.rstrip("/") + "/"):
                path = path[len(above) :]
            else:
                return False
        return re.match(regex, path if self.whole_path else posixpath.basename(path)) is not None

    def reaches(self, folder: str) -> bool:
        """Whether the rule could match something below a directory: the leading segments of one of its alternatives fit the directory's."""
        if not self.whole_path:
            return True
        plain = alternatives(self.body)
        return plain is None or any(self._leads(folder, body) for body in plain)

    @staticmethod
    def _leads(folder: str, body: str) -> bool:
        parts = body.split("/")
        for name, part in zip(folder.split("/"), parts):
            if part == "**":
                return True
            try:
                if not re.match(glob_regex(part) if _SPECIAL & set(part) else "^" + re.escape(part) + "$", name):
                    return False
            except GlobError:
                return True  # a bracket across segments
        return len(parts) > folder.count("/") + 1

    def column(self, path: Column, is_dir: Column) -> Column:
        if (regex := self.regex()) is None:
            return F.lit(False)
        target, under = path, None
        if self.base and self.base != ".":
            inside = F.startswith(path, F.lit(self.base + "/"))
            target = F.when(path == self.base, ".").when(inside, F.substr(path, F.lit(len(self.base) + 2)))
            under = (path == self.base) | inside
        if not self.whole_path:
            target = F.substring_index(target, "/", -1)
        literal = not _SPECIAL & set(self.body)
        hit = target == self.body if literal else F.rlike(target, F.lit(regex))
        if self.dirs_only:
            hit = is_dir & hit
        return hit if under is None else under & hit


def include(glob: str) -> Rule:
    """-i: keep what matches and, if any such rule is given, nothing else; a leading ! excludes."""
    return Rule(glob[1:], False) if glob.startswith("!") else Rule(glob, True, whitelist=True)


def exclude(glob: str) -> Rule:
    """-e: exclude what matches; a leading ! keeps."""
    return Rule(glob[1:], True) if glob.startswith("!") else Rule(glob, False)


def parse_ignore(text: str, base: str = "") -> list[Rule]:
    """Rules of an ignore file in `base`: comments, escapes, negation, one kept trailing blank after a backslash."""
    rules = []
    for line in text.split("\n"):
        line = line.removesuffix("\r").lstrip(" \t")
        bare = line.rstrip(" ")
        if bare != line and bare.endswith("\\"):
            bare = bare[:-1] + " "
        if not bare or bare.startswith("#"):
            continue
        keep = bare.startswith("!")
        bare = bare[1:] if keep or bare[:2] in ("\\!", "\\#") else bare
        slash = bare.endswith("/")
        clean = posixpath.normpath(bare) if bare else "."
        clean = re.sub("^//", "/", clean)
        rules.append(Rule(clean + "/" if slash and clean != "/" else clean, keep, base))
    return rules


def verdict(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """'keep' or 'ignore' by the last rule that matches, null if none does."""
    cases = None
    for rule in reversed(rules):
        hit, value = rule.column(path, is_dir), F.lit("keep" if rule.keep else "ignore")
        cases = F.when(hit, value) if cases is None else cases.when(hit, value)
    return F.lit(None).cast("string") if cases is None else cases


def _by_globs(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    found = verdict(path, is_dir, rules)
    return F.coalesce(found, F.when(~is_dir, "ignore")) if any(r.whitelist for r in rules) else found


def _judged(path: Column, is_dir: Column, globs: list[Rule], ignores: list[Rule], hidden: bool) -> Column:
    """Whether an entry is skipped: globs first, then ignore rules, then hidden names, which a keeping rule lifts."""
    said = F.coalesce(_by_globs(path, is_dir, globs), verdict(path, is_dir, ignores))
    name = F.substring_index(path, "/", -1)
    skip = F.when(said == "ignore", True).when(said == "keep", False)
    return F.coalesce(skip, F.startswith(name, F.lit(".")) & ~name.isin(".", "..") if not hidden else F.lit(False))


def accepted(path: Column, globs: list[Rule] = (), ignores: list[Rule] = (), hidden: bool = True) -> Column:
    """Whether a walk finds the file at `path`: neither it nor a directory above it is skipped.

    `hidden` lets hidden names through (the -H option).
    """
    globs, ignores = list(globs), list(ignores)
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    skipped_dir = F.coalesce(F.exists(above, lambda d: _judged(d, F.lit(True), globs, ignores, hidden)), F.lit(False))
    return ~(skipped_dir | _judged(path, F.lit(False), globs, ignores, hidden))
