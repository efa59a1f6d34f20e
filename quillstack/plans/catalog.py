"""Registered queries of the engine over the driver's tables, each with the SQL that DuckDB can check it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import dedup, globs, ranges, sections, slicing, tree
from ..operators.lineage import numbered
from .profiles import PROFILES

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files: path, text, size in bytes."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", F.octet_length("text").cast("long").alias("size"))


FILES = "f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text, octet_length(encode(text))::BIGINT AS size FROM documents)"
TOKENS = r"""
CASE WHEN strlen({t}) = 0 THEN 0 ELSE (100 * len(regexp_extract_all({t}, '[A-Za-z0-9_]+'))
 + greatest(0, length(regexp_replace({t}, '[^A-Za-z0-9_]+', '', 'g')) - 4 * len(regexp_extract_all({t}, '[A-Za-z0-9_]+'))) * 100 // 4
 + 55 * length(regexp_replace({t}, '[A-Za-z0-9_ \t\r\x0B\f\n\x{80}-\x{10FFFF}]+', '', 'g'))
 + 30 * len(regexp_extract_all({t}, '[ \t\r\x0B\f]+')) + 100 * (length({t}) - length(replace({t}, chr(10), '')))
 + 50 * (strlen({t}) - length(regexp_replace({t}, '[\x{80}-\x{10FFFF}]+', '', 'g')))) // 100 END::BIGINT"""
LINES = "(length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} <> '' AND right({t}, 1) <> chr(10) THEN 1 ELSE 0 END)::BIGINT"


def tokens_sql(t: str) -> str:
    return TOKENS.replace("{t}", t)


def lines_sql(t: str) -> str:
    return LINES.replace("{t}", t)


def newline_sql(t: str) -> str:
    return f"(CASE WHEN {t} <> '' AND right({t}, 1) <> chr(10) THEN {t} || chr(10) ELSE {t} END)"


# Text functions


@query("token_estimate", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("count_lines", f"SELECT doc_id, {lines_sql('text')} AS n_lines FROM documents")
def count_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.count_lines(F.col("text")).alias("n_lines"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), chr(39), '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query(
    "humanize",
    """WITH s AS (SELECT doc_id, (n_chars * n_chars * 37 + 250 * (doc_id % 9))::BIGINT AS size FROM documents)
    SELECT doc_id, size, CASE WHEN size < 1000 THEN size || ' B' WHEN size < 1000000 THEN printf('%.1f kB', size::DOUBLE / 1e3)
    WHEN size < 1000000000 THEN printf('%.1f MB', size::DOUBLE / 1e6) WHEN size < 1000000000000 THEN printf('%.1f GB', size::DOUBLE / 1e9)
    ELSE printf('%.1f TB', size::DOUBLE / 1e12) END AS shown FROM s""",
)
def humanize(spark, sf_dir):
    size = (F.col("n_chars") * F.col("n_chars") * 37 + 250 * (F.col("doc_id") % 9)).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", size.alias("size")).withColumn("shown", text.humanize(F.col("size")))


@query("commafy", "SELECT event_id, format('{:,}', event_id * 7919 - 1000000) AS shown FROM events")
def commafy(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.commafy(F.col("event_id") * 7919 - 1000000).alias("shown"))


@query("plural", f"SELECT doc_id, {lines_sql('text')} || CASE WHEN {lines_sql('text')} = 1 THEN ' line' ELSE ' lines' END AS shown FROM documents")
def plural(spark, sf_dir):
    n = text.count_lines(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(n.cast("string"), F.lit(" "), text.plural(n, "line", "lines")).alias("shown"))


@query("end_newline", f"SELECT doc_id, {newline_sql('text')} AS ended FROM documents")
def end_newline(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.end_newline(F.col("text")).alias("ended"))


@query("date_fmt", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS day, strftime(ts, '%d/%m/%y') AS short FROM events")
def date_fmt(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.date("2006-01-02 15:04:05", F.col("ts")).alias("day"), text.date("02/01/06", F.col("ts")).alias("short"))


SIZES = ["1", "0", "-5", "4096", "512k", "2MB", " 3 gb ", "1.5k", "10kb", "7g", "9B", "k", "", "12 k", "99999999999g", "+8", "9223372036854775807", "9223372036854775808", "0k", "1M"]
SIZES_SQL = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SIZES)) + ") AS v(id, raw)"


@query(
    "parse_size",
    f"""WITH p AS (SELECT region.r_regionkey::BIGINT AS region, id::INT AS id, raw, regexp_extract(lower(trim(raw)), '^\\+?([0-9]{{1,19}})(gb|mb|kb|g|m|k|b)?$', 1) AS d,
    regexp_extract(lower(trim(raw)), '^\\+?[0-9]{{1,19}}(gb|mb|kb|g|m|k|b)?$', 1) AS u FROM region, {SIZES_SQL}),
    n AS (SELECT region, id, raw, CASE WHEN d <> '' THEN d::HUGEINT END AS n, CASE left(u, 1) WHEN 'g' THEN 1000000000 WHEN 'm' THEN 1000000 WHEN 'k' THEN 1000 ELSE 1 END AS s FROM p)
    SELECT region, id, raw, CASE WHEN n > 0 AND n <= CASE WHEN s > 1 THEN 4611686018427387904 // s ELSE 9223372036854775807 END THEN (n * s)::BIGINT END AS bytes FROM n""",
)
def parse_size(spark, sf_dir):
    values = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("raw")) for i, s in enumerate(SIZES)])
    rows = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.explode(values).alias("v")).select("region", "v.*")
    return rows.withColumn("bytes", text.parse_size(F.col("raw")))


@query("data_uri", "SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS uri FROM pages")
def data_uri(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.data_uri(F.lit("text/html"), F.col("html").cast("binary")).alias("uri"))


#: Bytes put before a document's own, by doc_id: text, a NUL, a broken rune, and a rune cut off at byte 1024.
@query(
    "is_binary",
    """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS is_binary FROM documents""",
)
def is_binary(spark, sf_dir):
    own = F.encode(F.regexp_replace("text", "[^\\x01-\\x7F]", "x"), "UTF-8")
    pad = lambda head, tail: F.concat(F.lit(head), own, F.lit(tail))
    cut = F.concat(F.lit(b"a" * 1022 + "€".encode()), own)
    data = F.when(F.col("doc_id") % 4 == 1, pad(b"x\0y", b"")).when(F.col("doc_id") % 4 == 2, pad(b"ab\xc3\x28", b"")).when(F.col("doc_id") % 4 == 3, cut).otherwise(own)
    return read(spark, sf_dir, "documents").select("doc_id", text.is_binary(data).alias("is_binary"))


# Names and addresses

ENDS = ["main.go", "Lib.RS", "a.tar.gz", "Dockerfile", "dockerfile.dev", "x.TAR", "run", "page.xhtml", "doc.PDF", "pic.JPEG", "snd.m4a", "n.md", ".bashrc", "t.tsx", "k.odt", "v.svg", "go.mod", "data.unknown"]
ENDS_SQL = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(ENDS)) + ") AS e(k, name)"
PATHS = f"p AS (SELECT doc_id, source || '/' || name AS path, name FROM documents JOIN {ENDS_SQL} ON k = doc_id % {len(ENDS)})"


def _paths(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % len(ENDS) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", name).alias("path"))


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


EXT = "lower(regexp_extract(name, '\\.([^.]*)$', 1))"


@query(
    "detect_language",
    f"WITH {PATHS} SELECT doc_id, path, coalesce({_case(names.LANGUAGE_BY_FILE, 'lower(name)')}, CASE WHEN starts_with(lower(name), 'dockerfile.') THEN 'dockerfile' END, "
    f"{_case(names.LANGUAGE_BY_EXTENSION, EXT)}, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE '' END) AS language FROM p",
)
def detect_language(spark, sf_dir):
    first = F.when(F.col("doc_id") % 2 == 0, "#!/usr/bin/env python3 -u\nprint()").otherwise("plain")
    return _paths(spark, sf_dir).select("doc_id", "path", names.detect_language(F.col("path"), first).alias("language"))


@query("file_format", f"WITH {PATHS} SELECT doc_id, path, {EXT} AS format FROM p")
def file_format(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", names.file_format(F.col("path")).alias("format"))


@query("archive_suffix", f"WITH {PATHS} SELECT doc_id, path, regexp_matches(path, '{names.ARCHIVE_SUFFIX}') AS is_archive FROM p")
def archive_suffix(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", names.is_archive(F.col("path")).alias("is_archive"))


@query("is_document", f"WITH {PATHS} SELECT doc_id, path, regexp_matches(path, '{names.DOCUMENT_SUFFIX}') AS is_document, regexp_matches(path, '{names.HTML_SUFFIX}') AS is_html FROM p")
def is_document(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", names.is_document(F.col("path")).alias("is_document"), names.is_html(F.col("path")).alias("is_html"))


@query(
    "classify_ext",
    f"WITH {PATHS} SELECT doc_id, path, " + ", ".join(f"{_case({k: v[i] for k, v in names.FORMATS.items()}, EXT)} AS {c}" for i, c in enumerate(("format", "kind", "mime"))) + " FROM p",
)
def classify_ext(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", *(names.format_by_extension(F.col("path"), i).alias(c) for i, c in enumerate(("format", "kind", "mime"))))


@query(
    "url_inputs",
    r"SELECT page_id, url, regexp_matches(url, '(?i)^https?://[^/?#]+') AS is_url, regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS url_path, "
    f"regexp_matches(url, '(?i)^https?://[^/?#]+') AND regexp_matches(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), '{names.ARCHIVE_SUFFIX}') AS is_archive FROM pages",
)
def url_inputs(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", "url", names.is_http_url(url).alias("is_url"), names.url_path(url).alias("url_path"), names.is_http_archive(url).alias("is_archive"))


REPOS = {
    "https://github.com/a/b": "https://github.com/a/b/archive/HEAD.zip",
    "github.com/a/b.git": "https://github.com/a/b/archive/HEAD.zip",
    "https://github.com/a/b/tree/dev/x": "https://github.com/a/b/archive/refs/heads/dev/x.zip",
    "https://github.com/a/b/issues/3": None,
    "https://github.com/a": None,
    "https://gitlab.com/g/s/r": "https://gitlab.com/g/s/r/-/archive/HEAD/r-HEAD.zip",
    "https://gitlab.com/g/r/-/tree/v1": "https://gitlab.com/g/r/-/archive/v1/r-v1.zip",
    "https://gitlab.com/g/r/-/issues": None,
    "https://bitbucket.org/o/r/src/main": "https://bitbucket.org/o/r/get/main.zip",
    "codeberg.org/o/r/src/branch/main": "https://codeberg.org/o/r/archive/main.zip",
    "https://codeberg.org/o/r/src/tag/v1": None,
    "ftp://github.com/a/b": None,
    "https://example.org/a/b": None,
    "https://github.com/a/b/archive/HEAD.zip": None,
}


@query(
    "repo_url_rewrite",
    "SELECT page_id, raw, archive_url FROM pages JOIN (VALUES "
    + ", ".join(f"({i}, '{k}', {repr(v) if v else 'NULL'})" for i, (k, v) in enumerate(REPOS.items()))
    + f") AS v(k, raw, archive_url) ON k = page_id % {len(REPOS)}",
)
def repo_url_rewrite(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, REPOS)), (F.col("page_id") % len(REPOS) + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", raw.alias("raw")).withColumn("archive_url", names.repo_archive_url(F.col("raw")))


# Slices


def _slice(name: str, column, sql: str):
    @query(name, f"WITH l AS (SELECT doc_id, text, {lines_sql('text')} AS n, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls, "
        f"CASE WHEN right(text, 1) = chr(10) THEN chr(10) ELSE '' END AS fin FROM documents) SELECT doc_id, {sql} AS content FROM l")  # fmt: skip
    def run(spark, sf_dir):
        return read(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias("content"))

    return run


WHOLE = newline_sql("text")
_slice("head", lambda t: slicing.excerpt(t, 3), f"CASE WHEN n <= 3 THEN {WHOLE} ELSE array_to_string(ls[1:3], chr(10)) || chr(10) END")
_slice("tail", lambda t: slicing.excerpt(t, 0, 2), f"CASE WHEN n <= 2 THEN {WHOLE} ELSE array_to_string(ls[-2:], chr(10)) || fin END")
_slice(
    "lines_gap",
    lambda t: slicing.lines_option(t, 5),
    f"CASE WHEN n <= 5 THEN {WHOLE} ELSE array_to_string(ls[1:3], chr(10)) || chr(10) || '... (' || (n - 5) || ' rows skipped)' || chr(10) || array_to_string(ls[-2:], chr(10)) || fin END",
)
NUMBERED = "list_transform({list}, lambda x, i: lpad('', greatest(0, length(n::VARCHAR) - length((i + {first})::VARCHAR))::INT, ' ') || (i + {first}) || ': ' || x)"
_slice(
    "line_numbers",
    lambda t: slicing.lines_option(t, 4, numbers=True),
    "CASE WHEN text = '' THEN '' WHEN n <= 4 THEN array_to_string({a}, chr(10)) || chr(10) ELSE array_to_string({b}, chr(10)) || chr(10) || '... (' || (n - 4) || ' rows skipped)' || chr(10) || array_to_string({c}, chr(10)) || fin END".format(
        a=NUMBERED.format(list="ls", first="0"), b=NUMBERED.format(list="ls[1:2]", first="0"), c=NUMBERED.format(list="ls[-2:]", first="n - 2")
    ),
)


@query("compact", f"WITH {FILES} SELECT doc_id, path || ' (' || {lines_sql('text')} || ' rows)' AS header FROM f")
def compact(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.concat("path", F.lit(" ("), text.count_lines(F.col("text")).cast("string"), F.lit(" rows)")).alias("header"))


@query("max_size", f"WITH {FILES} SELECT doc_id, path, size FROM f WHERE size <= 1500")
def max_size(spark, sf_dir):
    return files(spark, sf_dir).where("size < 0 OR size <= 1500").select("doc_id", "path", "size")


# Rules

GLOBS_INCLUDE = [globs.include("src1*/**/*.txt"), globs.include("!**/de/**")]
GLOBS_EXCLUDE = [globs.exclude("*7.txt"), globs.exclude("src3/"), globs.exclude("!src3/en/1*.txt"), globs.exclude("/src5/{fr,es}/*")]
GLOBS_LAST = [globs.exclude("*.txt"), globs.exclude("!src1?/**"), globs.exclude("[0-9]*5.txt"), globs.exclude("!**/es/**")]


def _kept(name: str, rules, sql: str, **options):
    @query(name, f"WITH {FILES} SELECT doc_id, path FROM f WHERE {sql}")
    def run(spark, sf_dir):
        return files(spark, sf_dir).where(globs.accepted(F.col("path"), rules, **options)).select("doc_id", "path")

    return run


_kept("glob_include", GLOBS_INCLUDE, r"regexp_full_match(path, 'src1[^/]*/(?:[^/]*/)*[^/]*\.txt') AND NOT regexp_matches(path, '/de/')")
_kept("glob_exclude", GLOBS_EXCLUDE, r"NOT starts_with(path, 'src3/') AND NOT regexp_matches(path, '7\.txt$') AND NOT regexp_full_match(path, 'src5/(?:fr|es)/[^/]*')")
_kept("glob_dir_anti", [globs.exclude("fr/"), globs.exclude("src1*/es"), globs.exclude("!*.txt")], "NOT regexp_matches(path, '^[^/]*/fr/') AND NOT regexp_matches(path, '^src1[^/]*/es/')")


@query(
    "glob_last_match",
    f"""WITH {FILES}, r AS (SELECT * FROM (VALUES (1, '[^/]*\\.txt', true, false), (2, 'src1[^/]/[^/]*/.*', false, true), (3, '[0-9][^/]*5\\.txt', true, false), (4, '(?:[^/]*/)*es/[^/]*.*', false, true)) AS v(k, regex, base, keep)),
    m AS (SELECT doc_id, path, arg_max(keep, k) AS keep FROM f LEFT JOIN r ON regexp_full_match(CASE WHEN base THEN regexp_extract(path, '[^/]*$') ELSE path END, regex) GROUP BY ALL)
    SELECT doc_id, path, CASE WHEN keep THEN 'keep' WHEN NOT keep THEN 'ignore' END AS verdict FROM m""",
)
def glob_last_match(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "path", globs.verdict(F.col("path"), F.lit(False), GLOBS_LAST).alias("verdict"))


HIDDEN = "h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || source || '/' || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END || doc_id || '.txt' AS path FROM documents)"


def _hidden(spark, sf_dir):
    dot = lambda n: F.when(F.col("doc_id") % n == 0, ".").otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(dot(7), "source", F.lit("/"), dot(5), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


@query("hidden_filter", f"WITH {HIDDEN} SELECT doc_id, path FROM h WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def hidden_filter(spark, sf_dir):
    return _hidden(spark, sf_dir).where(globs.accepted(F.col("path"), hidden=False))


IGNORES = globs.parse_ignore("# notes\n*3.txt\n!13.txt\n/src2/\n!.*5.txt\n") + globs.parse_ignore("*9.txt\n", "src4")


@query(
    "ignore_judge",
    rf"""WITH {HIDDEN}, j AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM h)
    SELECT doc_id, path FROM j WHERE NOT starts_with(path, '.') AND NOT starts_with(path, 'src2/') AND
    CASE WHEN starts_with(path, 'src4/') AND regexp_full_match(name, '[^/]*9\.txt') THEN false WHEN regexp_full_match(name, '\.[^/]*5\.txt') THEN true
         WHEN name = '13.txt' THEN true WHEN regexp_full_match(name, '[^/]*3\.txt') THEN false ELSE NOT starts_with(name, '.') END""",
)
def ignore_judge(spark, sf_dir):
    return _hidden(spark, sf_dir).where(globs.accepted(F.col("path"), ignores=IGNORES, hidden=False))


# Sets and order

PIPED = "l AS (SELECT doc_id AS seq, source || '/' || lang AS path FROM documents UNION ALL SELECT 1000000 + doc_id, source || '/' || (doc_id % 50) FROM documents)"


@query("piped_dedup", f"WITH {PIPED} SELECT path, min(seq) AS seq FROM l GROUP BY path")
def piped_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    one = docs.select(F.col("doc_id").alias("seq"), F.concat_ws("/", "source", "lang").alias("path"))
    two = docs.select((F.col("doc_id") + 1000000).alias("seq"), F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("path"))
    return dedup.first_by_key(one.unionByName(two), ["path"], "seq").select("path", "seq")


@query("walk_order", f"WITH {FILES} SELECT doc_id, path, row_number() OVER (ORDER BY string_split(path, '/')) AS item_seq FROM f")
def walk_order(spark, sf_dir):
    rows = files(spark, sf_dir).select("doc_id", "path").withColumn("key", F.split("path", "/"))
    return numbered(rows, [F.col("key")], "item_seq").select("doc_id", "path", "item_seq")


@query(
    "prompt_shallowest",
    """WITH p AS (SELECT 'p' || (item_id % 17) AS name, CASE item_id % 3 WHEN 0 THEN 'p' || (item_id % 17) || '.md' WHEN 1 THEN 'lib/' || item_id || '/p' || (item_id % 17) || '.md' ELSE 'lib/p' || (item_id % 17) || item_id || '.md' END AS path FROM benchmark),
    r AS (SELECT DISTINCT name, path, length(path) - length(replace(path, '/', '')) AS depth FROM p), k AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY depth) AS rk FROM r)
    SELECT name, path, count(*) OVER (PARTITION BY name) AS candidates FROM k WHERE rk = 1""",
)
def prompt_shallowest(spark, sf_dir):
    i = F.col("item_id")
    name = F.concat(F.lit("p"), (i % 17).cast("string"))
    deep = F.concat(F.lit("lib/"), i.cast("string"), F.lit("/"), name, F.lit(".md"))
    path = F.when(i % 3 == 0, F.concat(name, F.lit(".md"))).when(i % 3 == 1, deep).otherwise(F.concat(F.lit("lib/"), name, i.cast("string"), F.lit(".md")))
    return dedup.shallowest(read(spark, sf_dir, "benchmark").select(name.alias("name"), path.alias("path")))


SPANS = "s AS (SELECT user_id, floor(epoch(ts))::BIGINT // 600 AS a, floor(epoch(ts))::BIGINT // 600 + event_id % 4 AS b FROM events)"


def _spans(spark, sf_dir):
    a = F.floor(F.unix_timestamp("ts") / 600)
    return read(spark, sf_dir, "events").select("user_id", a.alias("start"), (a + F.col("event_id") % 4).alias("end"))


MERGED = """m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM s WHERE a < b),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m)"""


@query("merge_ranges", f'WITH {SPANS}, {MERGED} SELECT user_id, min(a) AS start, max(b) AS "end" FROM g GROUP BY user_id, grp')
def merge_ranges(spark, sf_dir):
    return ranges.merge_ranges(_spans(spark, sf_dir), "user_id")


@query(
    "elision",
    "WITH r AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT // 600 AS \"row\" FROM events) SELECT user_id, \"row\", coalesce(\"row\" <> lag(\"row\") OVER (PARTITION BY user_id ORDER BY \"row\") + 1, false) AS elided_before FROM r",
)
def elision(spark, sf_dir):
    return ranges.elisions(_spans(spark, sf_dir).select("user_id", F.col("start").alias("row")).distinct(), "user_id")


# Totals and sections

ITEMS = """i AS (SELECT conv_id, turn, role, text, 'file' AS kind, octet_length(encode(text))::BIGINT AS size FROM conversations
    UNION ALL SELECT DISTINCT conv_id, -1, NULL, 'Conversation ' || conv_id, 'section', NULL FROM conversations)"""


def _items(spark, sf_dir) -> DataFrame:
    """Conversations as sections whose turns are files."""
    turns = read(spark, sf_dir, "conversations")
    file = turns.select("conv_id", "turn", "role", "text", F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"))
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    section = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), title.alias("text"), F.lit("section").alias("kind"), F.lit(None).cast("long").alias("size"))
    return file.unionByName(section)


@query(
    "plan_totals",
    f"WITH {FILES}, a AS (SELECT size FROM f UNION ALL SELECT -1 FROM pages) SELECT count(*) AS total_files, sum(CASE WHEN size >= 0 THEN size END)::BIGINT AS total_size, bool_or(size < 0) AS size_unknown, sum(size // 4)::BIGINT AS token_estimate FROM a",
)
def plan_totals(spark, sf_dir):
    known = files(spark, sf_dir).select(F.lit("file").alias("kind"), "size")
    return sections.plan_totals(known.unionByName(read(spark, sf_dir, "pages").select(F.lit("file").alias("kind"), F.lit(-1).cast("long").alias("size"))))


@query("section_totals", f"WITH {ITEMS} SELECT conv_id, count(*) AS total_files, sum(size)::BIGINT AS total_size FROM i WHERE kind = 'file' GROUP BY conv_id")
def section_totals(spark, sf_dir):
    return sections.section_totals(_items(spark, sf_dir), "conv_id")


ASSIGNED = f"""{ITEMS}, n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS item_seq FROM i),
    a AS (SELECT *, (sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (ORDER BY item_seq ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS section FROM n)"""


@query("section_assign", f"WITH {ASSIGNED} SELECT conv_id, turn, kind, item_seq, section, false AS is_implicit FROM a")
def section_assign(spark, sf_dir):
    rows = sections.with_sections(_items(spark, sf_dir).select("conv_id", "turn", "kind"), [F.col("conv_id"), F.col("turn")])
    return rows.select("conv_id", "turn", "kind", "item_seq", "section", "is_implicit")


INDEXED = f"""{ASSIGNED}, x AS (SELECT *, CASE WHEN kind = 'file' THEN row_number() OVER (PARTITION BY kind ORDER BY item_seq) END AS file_index,
    CASE WHEN kind = 'file' THEN row_number() OVER (PARTITION BY kind, section ORDER BY item_seq) END AS section_file_index,
    CASE WHEN kind = 'file' THEN count(*) OVER (PARTITION BY kind, section) END AS section_files FROM a)"""


@query("file_index", f"WITH {INDEXED} SELECT conv_id, turn, file_index, section_file_index, section_files FROM x WHERE kind = 'file'")
def file_index(spark, sf_dir):
    rows = sections.with_sections(_items(spark, sf_dir).select("conv_id", "turn", "kind"), [F.col("conv_id"), F.col("turn")])
    return sections.with_file_index(rows).where("kind = 'file'").select("conv_id", "turn", "file_index", "section_file_index", "section_files")


@query(
    "layout_separators",
    f"""WITH {ASSIGNED}, k AS (SELECT *, kind = 'file' AND turn % 3 <> 1 AS is_compact FROM a),
    p AS (SELECT *, lag(section) OVER o AS ps, lag(is_compact) OVER o AS pc FROM k WINDOW o AS (ORDER BY item_seq))
    SELECT item_seq, section, CASE WHEN ps IS NULL THEN '' WHEN ps <> section THEN chr(10) || chr(10) WHEN pc AND is_compact THEN chr(10) ELSE chr(10) || chr(10) END AS sep_before FROM p""",
)
def layout_separators(spark, sf_dir):
    rows = sections.with_sections(_items(spark, sf_dir).select("conv_id", "turn", "kind"), [F.col("conv_id"), F.col("turn")])
    marked = rows.withColumn("is_compact", (F.col("kind") == "file") & (F.col("turn") % 3 != 1))
    return sections.separators(marked).select("item_seq", "section", "sep_before")


# Trees

NODES = """pre AS (SELECT DISTINCT parts[1:k] AS path, k < len(parts) AS inn FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS k FROM t)),
    n AS (SELECT path, bool_or(inn) AS is_dir FROM pre GROUP BY path),
    o AS (SELECT path, path[1:len(path) - 1] AS parent, path[-1] AS name, len(path)::BIGINT AS depth, is_dir FROM n),
    d AS (SELECT *, row_number() OVER w AS rank, lead(name) OVER w IS NULL AS is_last FROM o WINDOW w AS (PARTITION BY parent ORDER BY NOT is_dir, name))"""


@query(
    "tree",
    f"""WITH {FILES}, t AS (SELECT DISTINCT string_split(path, '/') AS parts FROM f), {NODES},
    c AS (SELECT d.path, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) FILTER (a.depth < d.depth) AS bars FROM d JOIN d a ON a.depth <= d.depth AND d.path[1:a.depth] = a.path GROUP BY d.path)
    SELECT array_to_string(path, '/') AS path, depth, coalesce(bars, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM d JOIN c USING (path)""",
)
def tree_query(spark, sf_dir):
    nodes = tree.tree_nodes(files(spark, sf_dir).select(tree.path_parts(F.col("path")).alias("parts")))
    return tree.tree_lines(nodes).select(F.array_join("path", "/").alias("path"), "depth", "line")


@query(
    "tree_url",
    rf"""WITH u AS (SELECT lower(regexp_extract(url, '(?i)^(https?)://', 1)) || '://' || regexp_extract(url, '(?i)^https?://([^/?#]+)', 1) AS root, regexp_extract(url, '(?i)^https?://[^/?#]+/?([^?#]*)', 1) AS rest,
      regexp_extract(url, '(?i)^https?://[^/?#]+[^?#]*(\?[^#]+)', 1) AS query FROM pages), t AS (SELECT CASE WHEN rest = '' THEN [root] ELSE list_concat([root], string_split(rest || query, '/')) END AS parts FROM u), {NODES}
    SELECT array_to_string(path, '/') AS path, name, depth, is_dir, rank, is_last FROM d""",
)
def tree_url(spark, sf_dir):
    nodes = tree.tree_nodes(read(spark, sf_dir, "pages").select(tree.path_parts(F.col("url")).alias("parts")))
    return nodes.select(F.array_join("path", "/").alias("path"), "name", "depth", "is_dir", "rank", "is_last")


# Bundles


def bundle(spark, sf_dir, profile: str, first: int = -1, last: int = 0) -> DataFrame:
    """Documents in walk order, rendered: item_seq, doc_id, text (the item), tokens."""
    p = PROFILES[profile]
    rows = files(spark, sf_dir)
    order = numbered(rows.select("doc_id", F.split("path", "/").alias("key")), [F.col("key"), F.col("doc_id")], "file_index").select("doc_id", "file_index")
    total = F.broadcast(rows.agg(F.count("*").alias("section_files")))
    none = lambda kind: F.lit(None).cast(kind)
    full = rows.join(order, "doc_id").join(total, how="cross").select(
        "doc_id", "path", "file_index", F.col("file_index").alias("section_file_index"), "section_files", "size", names.detect_language(F.col("path"), F.col("text")).alias("language"),
        text.count_lines(F.col("text")).alias("rows"), F.lit(False).alias("is_estimate"), slicing.excerpt(F.col("text"), first, last).alias("content"),
        F.lit(False).alias("is_binary"), F.lit(False).alias("is_image"), slicing.is_compact(F.col("text"), first, last).alias("is_compact"),
        none("string").alias("read_error"), none("string").alias("skeleton_mode"), none("string").alias("data_uri"),
    )
    out = full.select(F.col("file_index").alias("item_seq"), "doc_id", p.file().alias("item"))
    return out.withColumn("tokens", text.token_estimate(F.col("item")))


BUNDLE = f"""{FILES}, b AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/'), doc_id) AS k, count(*) OVER () AS n, {lines_sql('text')} AS r, {WHOLE} AS body FROM f)"""
MD_HEAD = "CASE WHEN n > 1 THEN '[' || k || '/' || n || '] ' ELSE '' END || path || ' (' || r || ' rows)'"
ITEM_SQL = {
    "markdown": f"{MD_HEAD} || CASE WHEN text = '' THEN '' ELSE chr(10) || '---' || chr(10) || '```text' || chr(10) || body || '```' END",
    "xml": """'  <document index="' || k || '"' || CASE WHEN text = '' THEN '' ELSE ' language="text" rows="' || r || '"' END || '>' || chr(10) || '    <source>' || path || '</source>' || chr(10)
      || CASE WHEN text = '' THEN '    <description>Compact view</description>' ELSE '    <document_content>' || chr(10) || body || '    </document_content>' END || chr(10) || '  </document>'""",
    "html": """'<article id="file-' || k || '">' || chr(10) || '<header>' || chr(10) || CASE WHEN text = '' THEN ' <strong class="file-anchor">' || path || '</strong>' || chr(10) || ' <small>(' || r || ' rows - compact)</small>' || chr(10) || '</header>' || chr(10) || '<em>Compact view detected</em>'
      ELSE ' <a href="#file-' || k || '" aria-label="Link to this file"><strong>' || path || '</strong></a>' || chr(10) || ' <small>(' || r || ' rows)</small>' || chr(10) || '</header>' || chr(10) || '<pre><code class="language-text">' || chr(10)
      || replace(replace(replace(replace(replace(body, '&', '&amp;'), chr(39), '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') || '</code></pre>' END || chr(10) || '</article>' || chr(10)""",
    "bare": "CASE WHEN text = '' THEN '' ELSE body END",
}
for _name, _sql in ITEM_SQL.items():
    query(f"bundle_{_name}", f"WITH {BUNDLE}, o AS (SELECT k AS item_seq, doc_id, {_sql} AS item FROM b) SELECT *, {tokens_sql('item')} AS tokens FROM o")(
        lambda spark, sf_dir, profile=_name: bundle(spark, sf_dir, profile)
    )


@query(
    "bundle_sections",
    f"""WITH {INDEXED}, p AS (SELECT *, lag(section) OVER (ORDER BY item_seq) AS ps FROM x)
    SELECT item_seq, section, CASE WHEN ps IS NULL THEN '' ELSE chr(10) || chr(10) END || CASE WHEN kind = 'section' THEN '## ' || text || chr(10) || '---'
    ELSE CASE WHEN section_files > 1 THEN '[' || section_file_index || '/' || section_files || '] ' ELSE '' END || role || '/' || turn || '.md (' || {lines_sql('text')} || ' rows)'
      || CASE WHEN text = '' THEN '' ELSE chr(10) || '---' || chr(10) || '```markdown' || chr(10) || {WHOLE} || '```' END END AS item FROM p""",
)
def bundle_sections(spark, sf_dir):
    """Conversations as sections, their turns as files, with the layout's separators in front of each item."""
    items = _items(spark, sf_dir)
    placed = sections.with_file_index(sections.with_sections(items, [F.col("conv_id"), F.col("turn")]))
    p = PROFILES["markdown"]
    path = F.concat("role", F.lit("/"), F.col("turn").cast("string"), F.lit(".md"))
    blank = F.lit(None).cast("string")
    full = placed.withColumns(
        {
            "path": path, "body": F.col("text"), "language": names.detect_language(path), "rows": text.count_lines(F.col("text")), "is_estimate": F.lit(False), "content": F.col("text"),
            "is_binary": F.lit(False), "is_image": F.lit(False), "is_compact": (F.col("kind") == "file") & (F.col("text") == ""), "read_error": blank, "skeleton_mode": blank, "data_uri": blank,
        }
    )
    full = sections.separators(full)
    return full.select("item_seq", "section", F.concat("sep_before", F.when(F.col("kind") == "section", p.section()).otherwise(p.file())).alias("item"))


from . import content_queries  # noqa: E402, F401  registers the queries on file contents
