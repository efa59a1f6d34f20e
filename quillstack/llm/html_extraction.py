"""Operator 10, HTML extraction by tag-path ratios.

A page is read once into blocks of text, each with the tag path from the root to its element.  Per path, text length
and punctuation are summed and divided by the path's blocks; the two ratios are fused, weakened by the share of link
text, smoothed along the page, and paths over a threshold hold content.  The element that holds nearly all content is
the article: its blocks are returned, except those of menus, adverts, forms, comments and the like.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements whose content isn't markup or text of the page.
_RAW = frozenset("script style noscript template svg math iframe object textarea select canvas title".split())
_OPEN = re.compile(r"<!--|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)|<[!?/][^>]*+>")
#: The end of a tag or an attribute's value; quotes elsewhere are plain characters.
_STOP = re.compile(r">|=\s*+(?:(?P<quote>[\"'])|[^\s>][^\s>]*+)?+")
_UNCLOSED = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that an opening tag of the same set closes, up to the given parents.
_SIBLINGS = [
    (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dt", "dd"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    (frozenset(["option"]), frozenset(["select"])),
]
#: Elements that hold one block of an article, never the article.
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote caption figcaption summary address".split())
_HEAD = frozenset("meta link base title style script noscript template".split())
_SKIPPED_TAGS = frozenset("head nav aside form footer button menu dialog fieldset audio video map".split())
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_SKIPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|share|sharing|social|comments?|commentlist|respond|reply|replies|disqus|sidebar|side-bar|widget\w*|related|"
    r"recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|site-?header|page-?header|masthead|topbar|pagination|pager|skip-?link|search|toolbar)(?:$|[\s_-])",
    re.I,
)
#: What may stand beside such a word in a name of the article's own parts: "ad-slot" is an advert, "ad-hoc" isn't one.
_COMPANIONS = frozenset(
    "area bar block body bottom box button buttons center column container content desktop entry fixed form global group header heading holder icon icons inline inner item items left link links list main mobile "
    "article outer page panel post posts primary reader right row section secondary site slot small sticky story strip text thread title top unit user wrap wrapper zone".split()
)
_NAME_PARTS = re.compile(r"[\s_-]+")
_SIZE = re.compile(r"\d+(?:x\d+)?$")
#: Of a name's parts, "has-sidebar" and the like tell about the page's layout.
_LAYOUT_NAMES = re.compile(r"(?:^|[\s_-])(?:has|with|without|no|hide|hides)[_-][\w-]*", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACES = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "path", "depth", "skipped", "main", "form", "weight")

    def __init__(self, tag, parent, path, skipped, main):
        self.tag, self.parent, self.path, self.skipped, self.main, self.form = tag, parent, path, skipped, main, False
        self.depth, self.weight = (parent.depth + 1 if parent else 0), 0.0


def _named_chrome(value: str) -> bool:
    """Whether one of an element's names inside the article is a word of chrome, alone or with companions only."""
    for name in value.lower().split():
        if _SKIPPED_NAMES.search(name) and (_SKIPPED_NAMES.fullmatch(name) or all(not x or x in _COMPANIONS or _SKIPPED_NAMES.fullmatch(x) or _SIZE.match(x) for x in _NAME_PARTS.split(name))):
            return True
    return False


def _skipped(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag in _SKIPPED_TAGS or tag == "header" and not inside_main:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _SKIPPED_ROLES:
            return True
        if name in ("class", "id") and (_named_chrome(value) if inside_main else _SKIPPED_NAMES.search(_LAYOUT_NAMES.sub(" ", value))) or name == "style" and _HIDDEN.search(value):
            return True
    return False


def _tag_end(html: str, at: int, end: int, known: dict[int, int]) -> int:
    """Position of the ">" that ends a tag, past quoted values of any length; the next ">" if a quote is never closed.

    `known` has the result behind each opening quote seen (-1: none), so that a page is read once, however broken.
    """
    begin, opened, found = at, [], -1
    while m := _STOP.search(html, at, end):
        if m[0] == ">":
            found = m.start()
            break
        at = m.end()
        if m["quote"]:
            if at in known:
                found = known[at]
                break
            opened.append(at)
            at = html.find(m["quote"], at, end) + 1
            if not at:
                break
    known.update(dict.fromkeys(opened, found))
    return found if found >= 0 else html.find(">", begin, end)


def _tags(html: str, end: int):
    """(start, stop, tag, whether it closes, attributes, whether it never ends) of markup; tag is None for what is left out."""
    at, known = 0, {}
    while m := _OPEN.search(html, at, end):
        tag, attrs, never = m["tag"], "", False
        at = m.end()
        if m[0] == "<!--":
            stop = html.find("-->", at, end)
            never = stop < 0
            at = end if never else stop + 3
        elif tag:
            stop = _tag_end(html, at, end, known)
            attrs, at = html[at:stop], stop + 1
            if not m["close"] and tag.lower() in _RAW:
                last = re.compile(rf"</{tag}\s*>", re.I).search(html, at, end)
                never = last is None
                at, tag = end if never else last.end(), None
        yield m.start(), at, tag, bool(m["close"]), attrs, never


def blocks(html: str):
    """(text, node, share of link text) of each non-empty block outside skipped elements, in page order."""
    paths: dict[tuple, int] = {}
    root = _Node("", None, 0, False, False)
    stack, out, parts = [root], [], []
    links, linked = 0, 0  # open <a>; characters of link text in this block

    def flush():
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                node = stack[-1]
                while node.tag in _INLINE:
                    node = node.parent
                out.append((text, node, min(1.0, linked / len(text))))
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw and not stack[-1].skipped:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, end = 0, html.rfind(">") + 1
    for start, stop, tag, closes, attrs, never in _tags(html, end):
        say(html[at:start])
        at = stop
        if not tag:
            if never:
                at = len(html)  # unclosed: it takes all that follows
            continue
        tag = tag.lower()
        if stack[-1].tag == "head" and not closes and tag not in _HEAD:
            stack.pop()
        if tag == "br":
            say(" ")
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif closes:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # an inline end tag closes no block
        else:
            if tag not in _INLINE:
                flush()
                for i in range(len(stack) - 1, 0, -1):  # a block closes an open paragraph
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag not in _INLINE:
                        break
                for same, parents in _SIBLINGS:
                    if tag in same:
                        for i in range(len(stack) - 1, 0, -1):
                            if stack[i].tag in same:
                                del stack[i:]
                                break
                            if stack[i].tag in parents:
                                break
            elif tag == "a":
                links += 1
            top = stack[-1]
            path = paths.setdefault((top.path, tag), len(paths) + 1)
            main = top.main or tag in ("article", "main")
            wraps = tag == "main" or tag == "article" and top.form  # what only a form around the whole page would hide
            skipped = _skipped(tag, attrs, top.main)
            node = _Node(tag, top, path, skipped or top.skipped and not wraps, main)
            node.form = not wraps and (tag == "form" or top.form and not skipped)
            stack.append(node)
    rest = _UNCLOSED.search(html, max(at, end))
    say(html[at : rest.start() if rest else len(html)])
    flush()
    return out


def _list_of(node):
    while node and node.tag not in ("ul", "ol", "menu"):
        node = node.parent
    return node


def _menus(found) -> frozenset:
    """Lists like menus: several items, all of them short links without punctuation."""
    items: dict = {}
    for text, node, link in found:
        if (holder := _list_of(node)) is not None:
            items.setdefault(holder, []).append(link >= 0.9 and len(text) <= 30 and not _PUNCTUATION.search(text))
    return frozenset(holder for holder, short in items.items() if len(short) > 1 and all(short))


def main_text(html: str, inside: float = 0.8, bar: float = 0.25) -> str:
    """The article's blocks joined by line breaks."""
    found = blocks(html)
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    for text, node, link in found:
        s = sums.setdefault(node.path, [0.0, 0.0, 0.0])
        s[0] += len(text) * (1 - link)
        s[1] += len(_PUNCTUATION.findall(text)) * (1 - link)
        s[2] += 1
    fused = {p: (length / n) * (1 + marks / n) for p, (length, marks, n) in sums.items()}
    raw = [fused[node.path] * (1 - link) for _, node, link in found]
    wide = [raw[0], *raw, raw[-1]]
    smooth = [(wide[i] + 2 * wide[i + 1] + wide[i + 2]) / 4 for i in range(len(raw))]
    best: dict[int, float] = {}
    for (_, node, _), s in zip(found, smooth):
        best[node.path] = max(best.get(node.path, 0.0), min(s, 2 * fused[node.path]))
    limit = bar * max(best.values())
    total = 0.0
    for text, node, link in found:
        if best[node.path] >= limit:
            weight = len(text) * (1 - link)
            total += weight
            while node:
                node.weight += weight
                node = node.parent
    holders = set()
    for _, node, _ in found:
        while node and node not in holders:
            holders.add(node)
            node = node.parent
    article = max((n for n in holders if n.weight >= inside * total and n.tag not in _BLOCKS), key=lambda n: n.depth)
    core = article
    while article.parent and article.parent.weight > article.weight and article.tag not in ("article", "main", "body"):
        article = article.parent  # blocks beside it hold content, too
    up = article
    while up:  # the outermost <article> or <main> around it, if there is one
        if up.tag in ("article", "main"):
            article = up
        up = up.parent
    core = article if article.main else core
    whole = article.main or core.tag not in ("", "html", "body")
    menus = _menus(found) if article.main else frozenset()
    kept = []
    for text, node, link in found:
        heading = re.fullmatch(r"h[1-6]", node.tag) is not None
        content = best[node.path] >= limit
        up, inner = node, False
        while up and up is not article:
            inner = inner or up is core
            up = up.parent
        inner = inner or core is article or article.tag not in ("", "html", "body")
        linked = link >= 0.9 and (not article.main or _list_of(node) in menus)
        if up and (heading or whole and inner and not linked or content and link < 0.5):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars (code points).

    Null html counts as empty.  Pages of any length are read whole, a row at a time.  Repeated rows give repeated
    results, empty tables empty ones; other columns are neither read nor returned.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(t.as_py() or "") for t in batch.column(2)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
