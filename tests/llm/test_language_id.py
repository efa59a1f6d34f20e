import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from quillstack.llm import language_id as lid
from quillstack.llm.common import table

from ..support import SMALL

PAGES = T.StructType([T.StructField(c, T.LongType() if c == "page_id" else T.StringType()) for c in ("page_id", "url", "html", "lang", "host", "n")])
STEMS = {"de": "der die und nicht schön über keit ung zwischen", "en": "the and with that thing other ation ing which", "es": "que los para ción mente señor del años está", "fr": "les des être aux pour ment avec où français"}


def text(lang, n, r):
    return " ".join(r.choice(STEMS[lang].split()) for _ in range(n))


@pytest.fixture
def model(documents):
    r = random.Random(7)
    return lid.fit(documents([(i, text(lang, 80, r), lang, "s") for i, lang in enumerate(list(STEMS) * 20)]))


def page(i, url, html):
    return (i, url, html, None, None, None)


def test_pages(spark, model):
    r = random.Random(2)
    html = lambda lang, body: f'<html lang="{lang}-XX"><head><title>x</title><script>the and with that thing</script></head><body><!-- the and --><p>{body}</p></body></html>'
    rows = [page(i, f"https://www.{lang}-site.example.{lang}/{i}", html(lang, text(lang, 60, r))) for i, lang in enumerate(list(STEMS) * 25)]
    got = {x["page_id"]: x for x in lid.identify_pages(spark.createDataFrame(rows, PAGES), model).collect()}
    assert len(got) == 100
    for i, lang in enumerate(list(STEMS) * 25):
        x = got[i]
        assert (x["lang"], x["text_lang"], x["declared"], x["suffix"], x["accepted"]) == (lang, lang, lang, lang, True)


def test_host_decides_where_text_is_short(spark, model):
    r = random.Random(3)
    rows = [page(i, "http://a.example.com/x", f"<p>{text('fr', 40, r)}</p>") for i in range(60)]
    rows += [page(100 + i, "http://b.example.org/x", f"<p>{text('en', 40, r)}</p>") for i in range(60)]
    rows += [page(200, "http://a.example.com/y", "<p>zyx yxz</p>"), page(201, "http://b.example.org/y", "<p>zyx yxz</p>")]
    got = {x["page_id"]: x["lang"] for x in lid.identify_pages(spark.createDataFrame(rows, PAGES), model).collect()}
    assert (got[200], got[201]) == ("fr", "en")


def test_fusion_against_brute_force(spark, model):
    r = random.Random(5)
    rows = []
    for i in range(120):
        lang = r.choice(list(STEMS))
        host = r.choice([f"{lang}.example.{lang}", f"h{i % 7}.shared.com", "10.0.0.1", ""])
        body = text(lang, r.choice([0, 1, 3, 40]), r)
        said = r.choice([lang, "en", "xx", None])
        rows.append(page(i, f"http://{host}/p" if host else None, (f'<html lang="{said}">' if said else "") + f"<p>{body}</p>"))
    pages = spark.createDataFrame(rows, PAGES)
    cells = [x.asDict() for x in lid.text_evidence(pages.selectExpr("page_id id", "html text", "cast(null as string) declared", "url address"), model, markup=True).collect()]
    L = range(4)
    used = [c for c in cells if c["n"] >= lid.MIN_TRIGRAMS]
    sums = lambda key: _sums(used, key)
    whole = [sum(c[f"q{i}"] for c in used) for i in L]
    by = {k: sums(k) for k in ("host", "domain", "declared", "suffix")}
    got = {x["id"]: x for x in lid.fuse(spark.createDataFrame(cells, ", ".join(f"{k} {'string' if k in ('host', 'domain', 'suffix', 'declared') else 'long' if k in ('id', 'n') else 'double'}" for k in cells[0]))).collect()}
    assert len(got) == len(cells)
    for c in cells:
        own = [c[f"q{i}"] if c["n"] >= lid.MIN_TRIGRAMS else 0.0 for i in L]
        one = int(c["n"] >= lid.MIN_TRIGRAMS)
        s = []
        for i in L:
            at_all = (whole[i] + 1) / (len(used) + 4)
            d = by["domain"].get(c["domain"])
            at_domain = ((d[0][i] - own[i] if d else 0) + lid.HOST_PRIOR * at_all) / ((d[1] - one if d else 0) + lid.HOST_PRIOR)
            h = by["host"].get(c["host"])
            at_host = ((h[0][i] - own[i] if h else 0) + lid.HOST_PRIOR * at_domain) / ((h[1] - one if h else 0) + lid.HOST_PRIOR)
            z = c[f"e{i}"] + math.log(max(at_host, 1e-9))
            for f in ("declared", "suffix"):
                if c[f] is not None and c[f] in by[f]:
                    share = (by[f][c[f]][1] + 1) / (len(used) + 2)
                    z += math.log((by[f][c[f]][0][i] + lid.FIELD_PRIOR * share) / (whole[i] + lid.FIELD_PRIOR)) - math.log(share)
            s.append(z)
        x = got[c["id"]]
        if c["n"] < lid.MIN_TRIGRAMS:
            assert x["lang"] is None and not x["accepted"]
        else:
            assert x["lang"] == lid.LANGUAGES[s.index(max(s))]
            assert x["confidence"] == pytest.approx(1 / sum(math.exp(z - max(s)) for z in s))


def _sums(cells, key):
    out = defaultdict(lambda: ([0.0] * 4, 0))
    for c in cells:
        if c[key] is not None:
            s, n = out[c[key]]
            out[c[key]] = ([s[i] + c[f"q{i}"] for i in range(4)], n + 1)
    return out


def test_edges(spark, model):
    rows = [page(1, None, None), page(2, "::::", ""), page(3, "http://[bad", "<p>der die und nicht schön über</p>"), page(3, "http://[bad", "<p>der die und nicht schön über</p>"), page(None, "http://x.de", "<p>les des être aux pour</p>"), page(5, "http://x.fr", "les des être aux " * 60_000), page(6, "http://x.fr", "1234 5678 !!!! 9")]
    got = lid.identify_pages(spark.createDataFrame(rows, PAGES), model).collect()
    assert Counter(x["page_id"] for x in got) == {1: 1, 2: 1, 3: 2, None: 1, 5: 1, 6: 1}
    by = {x["page_id"]: x for x in got}
    assert [by[i]["accepted"] for i in (1, 2, 6)] == [False] * 3
    assert (by[3]["lang"], by[5]["lang"], by[None]["lang"]) == ("de", "fr", "fr")
    assert lid.identify_pages(spark.createDataFrame([], PAGES), model).count() == 0


def test_keep_identified(documents):
    r = random.Random(9)
    rows = [(i, text(lang, 40, r), lang, "s") for i, lang in enumerate(list(STEMS) * 10)] + [(100, None, "en", "s"), (101, "", None, None), (102, "1 2 3", "en", "s"), (None, "??", "en", "s")]
    df = documents(rows, clash=True)
    out = lid.keep_identified(df)
    assert out.columns == df.columns
    assert sorted(x["doc_id"] for x in out.collect() if x["doc_id"] is not None) == list(range(40))
    assert out.where("doc_id IS NULL").count() == 1
    assert lid.keep_identified(documents([])).count() == 0


def test_accuracy_on_the_tables(spark):
    got = lid.op6_language_id(spark, SMALL)
    pages = table(spark, SMALL, "pages")
    assert got.count() == pages.count()
    right = got.join(pages, "page_id").selectExpr("lang = regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS ok").collect()
    assert sum(bool(x["ok"]) for x in right) / len(right) > 0.97


def test_host_parts():
    assert lid.host_parts("https://A.b.Example.ORG./x") == ("a.b.example.org", "example.org", "org")
    assert lid.host_parts("http://10.0.0.1/x") == ("10.0.0.1", "10.0.0.1", None)
    assert lid.host_parts(None) == lid.host_parts("nothing") == (None, None, None)


def slow_trigrams(text):
    """Slots one by one: letters of the lower-cased text with one blank for each gap and at both ends."""
    letters = [32]
    for c in text.lower():
        code = ord(c)
        if 97 <= code <= 122 or code >= 0xC0 and code not in (0xD7, 0xF7) and not 0x2000 <= code <= 0x303F:
            letters.append(code)
        elif letters[-1] != 32:
            letters.append(32)
    if letters[-1] != 32:
        letters.append(32)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        h = (a * 2654435761 + b * 2246822519 + c * 3266489917) % 2**32
        h ^= h >> 15
        yield (h * 668265263 % 2**32) >> 16


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
def test_trigrams_have_no_seams(monkeypatch, block):
    monkeypatch.setattr(lid, "BLOCK", block)
    for t in ("", "a", "ab  cd", "  -- ", "Été, 12 straße!", "x" * 64, "x" * 63 + " y", "Ελλάς 漢字 – ok"):
        assert [int(x) for piece in lid.trigrams(t) for x in piece] == list(slow_trigrams(t))


def test_text_likelihood_against_brute_force(spark, documents):
    """Counts, log-probabilities and evidence from plain dictionaries; one text is over a megabyte."""
    r = random.Random(6)
    rows = [(i, text(lang, 30, r), lang, "s") for i, lang in enumerate(list(STEMS) * 5)] + [(90, text("en", 230_000, r), "en", "s"), (91, "nur so", "xx", "s"), (92, None, "de", "s"), (93, "der, die", None, "s")]
    counts = {lang: Counter(s for _, t, own, _ in rows if own == lang for s in slow_trigrams(t or "")) for lang in lid.LANGUAGES}
    total = {lang: sum(c.values()) + lid.SLOTS * lid.TRIGRAM_PRIOR for lang, c in counts.items()}
    model = lid.fit(documents(rows))
    asked = documents(rows + [(94, "zwischen den Jahren", None, None)]).selectExpr("doc_id AS id", "text", "lang AS declared", "source AS address")
    for x in lid.text_evidence(asked, model).collect():
        slots = list(slow_trigrams(next((t for i, t, *_ in rows if i == x["id"]), "zwischen den Jahren") or ""))
        e = [sum(math.log((counts[lang][s] + lid.TRIGRAM_PRIOR) / total[lang]) for s in slots) for lang in lid.LANGUAGES]
        assert x["n"] == len(slots)
        assert x["fit"] == pytest.approx(max(e) / len(slots) if slots else 0, rel=1e-4)
        for i in range(4):
            assert x[f"e{i}"] == pytest.approx(e[i] * min(len(slots), lid.EVIDENCE) / len(slots) if slots else 0, rel=1e-4)


def test_languages_come_from_the_labels(documents):
    rows = [(i, "t", lang, "s") for i, lang in enumerate(["pt"] * 600 + ["it"] * 500 + ["xy"] + [None] * 3000)]
    assert lid.languages_of(documents(rows)) == ("it", "pt")
    assert lid.languages_of(documents(rows), most=1) == ("pt",) and lid.languages_of(documents([])) == lid.LANGUAGES
