"""Output profiles as Column builders over rendered-file columns.

Expected columns: path, file_index, section_files, section_file_index, language, rows, is_estimate, content, size,
is_binary, is_image, is_compact, read_error, skeleton_mode, data_uri; for titles and bodies: body, section, is_implicit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import end_newline, html_escape, humanize

c, lit = F.col, F.lit


def _cat(*parts) -> Column:
    return F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])


def _rows() -> Column:
    return _cat(F.when(c("is_estimate"), "~").otherwise(""), c("rows").cast("string"), " rows")


def _mode() -> Column:
    return F.when(F.coalesce(c("skeleton_mode"), lit("")) != "", _cat(", ", c("skeleton_mode"))).otherwise("")


def _name() -> Column:
    number = _cat("[", c("section_file_index").cast("string"), "/", c("section_files").cast("string"), "] ")
    return _cat(F.when(c("section_files") > 1, number).otherwise(""), c("path"))


@dataclass(frozen=True)
class Profile:
    """Templates of one output format; each is a function to a Column."""

    content: Callable
    error: Callable
    binary: Callable
    compact: Callable
    image: Callable
    prompt: Callable
    tree: Callable
    meta: Callable
    section: Callable
    section_header: Callable = lambda: lit("")
    section_footer: Callable = lambda: lit("")
    header: Callable = lambda: lit("")
    footer: Callable = lambda: lit("")
    separators: bool = False
    embeds_images: bool = False

    def file(self) -> Column:
        """The template that a file's state picks."""
        return (
            F.when(c("read_error").isNotNull(), self.error())
            .when(c("is_image"), self.image())
            .when(c("is_binary"), self.binary())
            .when(c("is_compact"), self.compact())
            .otherwise(self.content())
        )


def _fence(lang: Column | str, body: Column) -> Column:
    return _cat("```", lang, "\n", end_newline(body), "```")


def _md_binary() -> Column:
    return _cat(_name(), " - binary file skipped (", humanize(c("size")), ")")


MARKDOWN = Profile(
    content=lambda: _cat(_name(), " (", _rows(), _mode(), ")\n---\n", _fence(c("language"), c("content"))),
    error=lambda: _cat(_name(), " - error: ", c("read_error")),
    binary=_md_binary,
    image=_md_binary,
    compact=lambda: _cat(_name(), " (", _rows(), _mode(), ")"),
    prompt=lambda: end_newline(c("body")),
    tree=lambda: _fence("", c("body")),
    meta=lambda: _fence("", c("body")),
    section=lambda: _cat("## ", end_newline(c("body")), "---"),
    footer=lambda: lit("\n\n"),
    separators=True,
)


def _xml_document(inner: Column, attributes: Column | str = "") -> Column:
    return _cat('  <document index="', c("file_index").cast("string"), '"', attributes, ">\n    <source>", c("path"), "</source>\n", inner, "\n  </document>")


def _xml_binary() -> Column:
    return _xml_document(_cat("    <error>Binary file (", humanize(c("size")), ")</error>"))


def _xml_attributes() -> Column:
    lang = F.when(c("language") != "", _cat(' language="', c("language"), '"')).otherwise("")
    mode = F.when(F.coalesce(c("skeleton_mode"), lit("")) != "", _cat(' skeleton="', c("skeleton_mode"), '"')).otherwise("")
    return _cat(lang, ' rows="', c("rows").cast("string"), '"', mode)


def _xml_body(tag: str) -> Callable:
    return lambda: _cat(f"  <{tag}>\n", end_newline(c("body")), f"  </{tag}>")


XML = Profile(
    content=lambda: _xml_document(_cat("    <document_content>\n", end_newline(c("content")), "    </document_content>"), _xml_attributes()),
    error=lambda: _xml_document(_cat("    <error>", c("read_error"), "</error>")),
    binary=_xml_binary,
    image=_xml_binary,
    compact=lambda: _xml_document(lit("    <description>Compact view</description>")),
    prompt=_xml_body("instruction"),
    tree=_xml_body("tree"),
    meta=_xml_body("system_context"),
    section=lambda: _cat("  <section_name>", c("body"), "</section_name>"),
    section_header=lambda: F.when(c("is_implicit"), "<content>\n").otherwise("<section>\n"),
    section_footer=lambda: F.when(c("is_implicit"), "\n</content>").otherwise("\n</section>"),
    footer=lambda: lit("\n\n"),
    separators=True,
)


def _html_article(inner: Column) -> Column:
    return _cat('<article id="file-', c("file_index").cast("string"), '">\n<header>\n', inner, "\n</article>\n")


def _html_link() -> Column:
    return _cat(' <a href="#file-', c("file_index").cast("string"), '" aria-label="Link to this file"><strong>', c("path"), "</strong></a>")


def _html_plain(rest: Column) -> Column:
    return _html_article(_cat(' <strong class="file-anchor">', c("path"), "</strong>", rest))


def _html_content() -> Column:
    small = F.when(c("size") > 0, _cat("\n <small>(", _rows(), F.when(c("is_compact"), " - compact").otherwise(""), ")</small>")).otherwise("")
    lang = F.when(c("language") != "", _cat(' class="language-', c("language"), '"')).otherwise("")
    return _html_article(_cat(_html_link(), small, "\n</header>\n<pre><code", lang, ">\n", end_newline(html_escape(c("content"))), "</code></pre>"))


_STYLE = (
    "body{margin:2rem auto;max-width:72rem;font-family:system-ui,sans-serif}pre{overflow:auto}img{max-width:100%}"
    "article>header{position:sticky;top:0;background:Canvas}.error-state{color:#b00}.file-anchor{font-weight:bold}"
)
HTML = Profile(
    content=_html_content,
    error=lambda: _html_plain(_cat('\n</header>\n<p class="error-state">Error: ', c("read_error"), "</p>")),
    binary=lambda: _html_plain(_cat("\n</header>\n<em>Binary file (", humanize(c("size")), ")</em>")),
    image=lambda: _html_article(_cat(_html_link(), '\n</header>\n<img src="', c("data_uri"), '" alt="', c("path"), '" />')),
    compact=lambda: _html_plain(_cat("\n <small>(", _rows(), " - compact)</small>\n</header>\n<em>Compact view detected</em>")),
    prompt=lambda: _cat("<blockquote>", end_newline(c("body")), "</blockquote>"),
    tree=lambda: _cat('<pre class="file-tree">', end_newline(html_escape(c("body"))), "</pre>"),
    meta=lambda: _cat('<pre class="system-context">', end_newline(html_escape(c("body"))), "</pre>"),
    section=lambda: _cat('<h2><a href="#section-', c("section").cast("string"), '" style="text-decoration:none; color:inherit;">', end_newline(c("body")), "</a></h2>"),
    section_header=lambda: F.when(c("is_implicit"), "").otherwise(_cat('<section id="section-', c("section").cast("string"), '">')),
    section_footer=lambda: F.when(c("is_implicit"), "").otherwise("</section>"),
    header=lambda: _cat(
        f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>Bundle</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n<header>\n<h1>Bundle</h1>\n<p>Files: ',
        c("total_files").cast("string"), F.when(~c("size_unknown"), _cat(" &bull; Size: ", humanize(c("total_size")))).otherwise(""), "</p>\n</header>\n<main>\n",
    ),
    footer=lambda: lit("</main>\n</body>\n</html>\n"),
    embeds_images=True,
)


def _nothing() -> Column:
    return lit("")


BARE = Profile(
    content=lambda: end_newline(c("content")), error=_nothing, binary=_nothing, compact=_nothing, image=_nothing,
    prompt=_nothing, tree=_nothing, meta=_nothing, section=_nothing,
)
PROFILES = {"markdown": MARKDOWN, "xml": XML, "html": HTML, "bare": BARE}


def profile_for(name: str) -> Profile:
    if (name or "markdown") not in PROFILES:
        raise ValueError(f"unknown output format {name!r}: choose markdown, xml, html or bare")
    return PROFILES[name or "markdown"]
