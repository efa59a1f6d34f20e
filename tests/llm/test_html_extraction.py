import html as markup
import random
import re
import time

import pytest
from pyspark.sql import types as T

from quillstack.llm import html_extraction
from quillstack.llm.common import table

from ..support import SMALL

PAGES = T.StructType([T.StructField(c, T.LongType() if c == "page_id" else T.StringType()) for c in ("page_id", "url", "html", "text", "n_chars")])
TITLE = "A day at the market"
BODY = [
    "The stalls open early, when the first vans arrive; by eight, the square is full of voices.",
    "Apples, pears and cheese from the hills are sold here. Prices are written on slates, and nobody haggles.",
    "At noon the bells ring & the sellers pack up, tired but content. So it has been for a hundred years.",
]
NOISE = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News, sport, weather</a></li></ul></nav>"


def paragraphs(close=True):
    return "".join(f"<p>{markup.escape(p)}{'</p>' if close else ''}" for p in BODY)


PLAIN = "\n".join([TITLE, *BODY])
TEMPLATES = {
    "article": f"<html><head><title>x</title></head><body><header>Site name</header>{NOISE}<article><h1>{TITLE}</h1>{paragraphs()}</article><footer>&copy; Us, all rights reserved.</footer></body></html>",
    "main and aside": f"<body>{NOISE}<main><h1>{TITLE}</h1>{paragraphs()}<aside>Read more: ten tips, all free.</aside></main></body>",
    "only divs": f'<body><div id="header">The Daily News. Since 1900.</div><div class="menu"><a href="a">A</a> <a href="b">B</a></div><div class="wrap"><div class="content"><h1>{TITLE}</h1>{paragraphs()}</div><div class="sidebar"><p>Popular: one, two, three.</p></div></div><div id="footer">Imprint. Contact.</div></body>',
    "layout names": f'<body class="no-js with-ads"><div class="site has-sidebar"><div class="post"><h1>{TITLE}</h1>{paragraphs()}</div></div></body>',
    "unclosed": f"<html><body>{NOISE}<article><h1>{TITLE}</h1>{paragraphs(close=False)}</article><footer>The end.",
    "upper case and odd quotes": f"<HTML><BODY><DIV CLASS=ad>Buy now, pay later!</DIV><ARTICLE><H1 title='a > b'>{TITLE}</H1>{paragraphs().replace('<p>', '<P>').replace('</p>', '</P>')}</ARTICLE></BODY></HTML>",
    "scripts, styles, markup": f'<body><script>var a = "</p><p>no</p>"; if (a < 1) {{}}</script><style>p > a {{}}</style><!-- <p>no, not this.</p> --><article><h1>{TITLE}</h1><script>x()</script>{paragraphs()}<noscript>Turn it on.</noscript><svg><text>no</text></svg></article></body>',
    "notices, forms, comments": f'<body><div class="cookie-notice">We use cookies, as everyone does.</div><article><h1>{TITLE}</h1>{paragraphs()}<form><label>Name</label><input><button>Send</button></form><section id="comments"><h2>Comments</h2><p>First! Great text, thanks a lot for it.</p><article class="comment"><p>I agree, of course.</p></article></section></article><div class="newsletter-signup">Subscribe, it is free.</div></body>',
    "a form around it all": f"<body><form id=f><div>{NOISE}</div><article><h1>{TITLE}</h1>{paragraphs()}</article></form></body>",
    "headers inside": f"<body><article><header><h1>{TITLE}</h1></header>{paragraphs()}<footer>Filed under: markets.</footer></article></body>",
    "inline elements": f"<body><article><h1>{TITLE}</h1>{paragraphs().replace('square', '<b>squ<i>are</i></b>').replace('cheese', '<a href=c>cheese</a>')}</article></body>",
    "no end of head or body": f"<html><head><title>x</title><meta charset=utf-8><style>p > a {{}}</style><body>{NOISE}<article><h1>{TITLE}</h1>{paragraphs()}</article>",
    "unclosed comment": f"<body><article><h1>{TITLE}</h1>{paragraphs()}</article><!-- no <p>not this, it never ends.</p> nor this",
    "white space": f"<body>\n<article>\n\t<h1>  {TITLE.replace(' ', '   ')}\n</h1>\n{paragraphs().replace(' ', chr(10) + chr(9), 9)}\n</article></body>",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    assert html_extraction.main_text(TEMPLATES[name]) == PLAIN


def test_lists_tables_and_headings_stay():
    body = f"<article><h1>{TITLE}</h1>{paragraphs()}<h2>What to buy</h2><ul><li>Bread, of rye<li>Honey</ul><table><tr><td>Eggs</td><td>3</td></tr></table></article>"
    assert html_extraction.main_text(body) == PLAIN + "\nWhat to buy\nBread, of rye\nHoney\nEggs\n3"


def test_character_references():
    page = "<article><p>Fish &amp; chips &#8212; 5&nbsp;&pound;, caf&eacute;; a &lt;tag&gt; &#x1F600; and &unknown; stay as they are, mostly.</p></article>"
    assert html_extraction.main_text(page) == "Fish & chips — 5 £, café; a <tag> 😀 and &unknown; stay as they are, mostly."


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<html>", "<!-- ", "<script>", "<a href='", "</p></p>", "<p></p>", "&amp", "<![CDATA[x]]>", "<nav>only, a menu</nav>", "<\0>"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_extraction.main_text(page), str)


def test_random_markup_does_not_fail():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<div class=", '"ad"', "'", ">", "<", "text, here. ", "<b>", "</i>", "<table>", "<td>", "&lt;", "<!--", "-->", "<script>", "</script>", "<article>", "</article>", "<li>"]
    for _ in range(500):
        html_extraction.main_text("".join(r.choice(bits) for _ in range(r.randrange(60))))


def test_long_pages_take_linear_time():
    for piece in ("<p>Words, and more words. </p>", "<div>", '<a href="x">', "<", "<!", "<p class='", "<a '>' ", "&amp;", 'a="b" <b ', "<!-- -", "<script>", "<script '>' "):
        for end in ("", ">"):
            began = time.process_time()
            html_extraction.main_text(piece * (200_000 // len(piece)) + end)
            assert time.process_time() - began < 20


def test_rows(spark):
    rows = [(1, "u", TEMPLATES["article"], None, None), (2, None, None, None, None), (3, "u", "", None, None), (None, "u", "<p>One, two, three.</p>", None, None), (1, "u", TEMPLATES["article"], None, None)]
    got = html_extraction.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(((x["page_id"], x["url"], x["text"], x["n_chars"]) for x in got), key=repr) == sorted([(1, "u", PLAIN, len(PLAIN))] * 2 + [(2, None, "", 0), (3, "u", "", 0), (None, "u", "One, two, three.", 16)], key=repr)
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_small_table(spark):
    """Every page's article there, by a plain reading of the one template that the table has."""
    pages = {x["page_id"]: x["html"] for x in table(spark, SMALL, "pages").collect()}
    got = html_extraction.op10_html_extraction(spark, SMALL).collect()
    assert len(got) == len(pages)
    for x in got:
        inner = re.search("<article>(.*?)</article>", pages[x["page_id"]], re.S)[1]
        parts = re.split("</?(?:h1|p)>", inner)
        want = [" ".join(markup.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert x["text"] == "\n".join(p for p in want if p)
        assert x["n_chars"] == len(x["text"])


@pytest.mark.parametrize("page", ["<body><div><h1>T</h1><p>{0}</p><p>Short, too.</p></div></body>", "<body><div><h1>T</h1><section><p>{0}</p></section><section><p>Short, too.</p></section></div></body>"])
def test_one_dominant_block_hides_no_other(page):
    long = "A long paragraph, with commas and stops. " * 60
    assert html_extraction.main_text(page.format(long)) == f"T\n{long.strip()}\nShort, too."


def test_links_inside_an_article_stay_but_menus_go():
    links = "<p><a href=p>A paragraph that is a link, whole.</a></p><ol><li><a href=r>Smith, J. (1999). On markets, old and new.</a></li><li><a href=s>Jones, K. (2001). On squares.</a></li></ol>"
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
    page = f"<body><article><h1><a href=x>{TITLE}</a></h1>{menu}{paragraphs()}{links}</article></body>"
    want = PLAIN + "\nA paragraph that is a link, whole.\nSmith, J. (1999). On markets, old and new.\nJones, K. (2001). On squares."
    assert html_extraction.main_text(page) == want


def test_long_and_many_attributes_do_not_leak():
    value = "x" * 3000 + '<b>secret</b> more'
    many = " ".join(f'a{i}="v"' for i in range(150))
    page = f"<body><article><h1>{TITLE}</h1><div data-x=\"{value}\" {many} data-y='a > b'>{paragraphs()}</div></article></body>"
    assert html_extraction.main_text(page) == PLAIN


def test_broken_quotes_take_linear_time():
    for piece in ("<p class='", '<a b="c\'', "<a b='\">"):
        for end in (">", "'>'", "=\">\""):
            began = time.process_time()
            html_extraction.main_text(piece * 40_000 + end)
            assert time.process_time() - began < 20


def test_short_blocks_stay_where_the_page_has_another_content_block():
    long = "A long paragraph, with commas and stops. " * 60
    page = f"<body><div><h1>T</h1><p>{long}</p><ul><li>Bread</li><li>Honey</li></ul></div><div><p>{long[:200]}</p></div></body>"
    assert html_extraction.main_text(page).split("\n")[2:4] == ["Bread", "Honey"]


@pytest.mark.parametrize(
    "inner, stays",
    [
        ('<p class="search-term">A term to look up, they say.</p>', True), ('<div class="related-work"><p>Related work, by others.</p></div>', True), ('<p class="ad-hoc">An ad-hoc remark.</p>', True),
        ('<div class="menu-planning"><p>Planning of menus, in brief.</p></div>', True), ('<p class="notice-board">The board said so.</p>', True), ('<p class="lead has-ads">A lead, of sorts.</p>', True),
        ('<div class="social history"><p>Two names, one of chrome.</p></div>', False), ('<div class="ad-slot ad-300x250">Buy now!</div>', False), ('<div class="share-buttons">Share this</div>', False),
        ('<section class="reader-comments"><p>Nice, I agree.</p></section>', False), ('<div id="comments_list"><p>First!</p></div>', False), ('<div class="newsletter-box">Sign up, it is free.</div>', False),
        ('<div class="related">Other pages: one, two.</div>', False), ('<p><a href="r">See the full report</a></p>', True), ('<h2><a href="h">Linked headline</a></h2>', True),
    ],
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>", "<div id=x><article class=post>{}</article></div>"])
def test_names_inside_the_article(inner, stays, around):
    text = re.sub("<[^>]*>", "", inner)
    got = html_extraction.main_text(f"<body>{NOISE}{around.format(f'<h1>{TITLE}</h1>{paragraphs()}{inner}{paragraphs()}')}<footer>End.</footer></body>")
    assert got == "\n".join([TITLE, *BODY, *([text] if stays else []), *BODY])
