import re

from quillstack.llm import substring_dedup

from ..support import SMALL, assert_same, views
from .conftest import rows_of

COLUMNS = ("doc_id", "n_units", "n_removed", "removed_chars", "spans", "kept_text")


def pieces(text):
    """Units by a scan over characters: a line break, or blanks after a sentence mark and its closing quotes, end one."""
    out, start, i = [], 0, 0
    while i < len(text):
        j = i + 1
        if text[i] in ".!?…":
            while j < len(text) and text[j] in "\"'”’)]":
                j += 1
            k = j
            while k < len(text) and text[k] in " \t":
                k += 1
            j = k if k > j else i + 1
            ends = k > i + 1 and text[k - 1] in " \t"
        else:
            ends = text[i] in "\n。！？"
        if ends:
            out.append((start, j))
            start = j
        i = j
    return out + [(start, len(text))]


def brute(rows, least=3, run=15):
    units = {t: [(s, e, tuple(re.findall(r"[^\x20\x09-\x0D]+", t[s:e].lower()))) for s, e in pieces(t)] for _, t in rows if t}
    seen, again = {}, set()
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        for s, _, words in units[t]:
            if len(words) >= least and seen.setdefault(words, (i, s)) != (i, s):
                again.add((i, s))
    out = []
    for i, t in rows:
        own = [u for u in units.get(t, []) if u[2]]
        hashed = [u for u in own if len(u[2]) >= least]
        runs, at = [], 0
        while at < len(hashed):
            to = at
            while to < len(hashed) and (i, hashed[to][0]) in again:
                to += 1
            if sum(len(u[2]) for u in hashed[at:to]) >= run:
                runs.append((hashed[at][0], hashed[to - 1][1], to - at))
            at = max(to, at + 1)
        gone = {x for s, e, _ in runs for x in range(s, e)}
        kept = "".join(c for x, c in enumerate(t or "") if x not in gone)
        out.append((i, len(own), sum(n for *_, n in runs), len(gone), ",".join(f"{s}-{e}" for s, e, _ in runs), kept))
    return sorted(out, key=repr)


PASSAGE = "The quick brown  fox jumps over it. Yes! \"No dog is lazy,\" said the hen.\tAll of them laughed (at last.) And so did we"
EDGES = [
    (9, PASSAGE),
    (2, f"{PASSAGE}\nown words of this one\n{PASSAGE.upper()}"),
    (3, None),
    (4, ""),
    (5, f"\n\n{PASSAGE}\n"),
    (6, "a b c d\na b c d"),
    (7, f"Before it. {PASSAGE}. After it comes more"),
    (None, PASSAGE),
    (8, f"{PASSAGE} é.\n\nÉ. 1.5 is no end... 一つ。二つ！\n{PASSAGE} é.\nThe quick brown fox jumps over it."),
    (8, f"{PASSAGE} é.\n\nÉ. 1.5 is no end... 一つ。二つ！\n{PASSAGE} é.\nThe quick brown fox jumps over it."),
    (10, "z q w e r " * 60_000),
    (11, "One short repeat here. All of them laughed (at last.) Nothing else is known.\nThe quick brown fox jumps over it."),
    (12, "....!? ?? \"'' . \t\n.\n"),
]


def test_edges_against_brute_force(documents):
    want = brute(EDGES)
    assert rows_of(substring_dedup.remove_repeats(documents(EDGES, clash=True)), *COLUMNS) == want
    assert {x[0] for x in want if x[2]} == {5, 7, 8, 9, 2}  # 11 has repeats, but no run of 15 words


def test_rows_without_id_come_back_whole(documents):
    got = [x for x in substring_dedup.remove_repeats(documents([(None, PASSAGE), (1, PASSAGE), (None, PASSAGE)])).collect()]
    assert all(x["kept_text"] == PASSAGE and not x["n_removed"] for x in got) and len(got) == 3


def test_paragraphs(documents):
    rows = [(1, "one two three\nfour five\n\nunique para graph is here"), (2, "other words stand in here\n \nOne two  three\nfour five"), (3, "one two three four five six")]
    got = {x["doc_id"]: x for x in substring_dedup.remove_repeats(documents(rows), unit="paragraph").collect()}
    assert got[2]["kept_text"].strip() == "other words stand in here" and got[2]["n_removed"] == 1
    assert [got[i]["n_removed"] for i in (1, 3)] == [0, 0]
    s, e = map(int, got[2]["spans"].split("-"))
    assert rows[1][1][s:e] == "One two  three\nfour five"


def test_empty_table(documents):
    assert substring_dedup.remove_repeats(documents([])).count() == 0


def test_query_equals_sql(spark):
    assert_same(substring_dedup.op1_substring_dedup(spark, SMALL), views(SMALL), substring_dedup.OP1_SQL)
