"""Catalogue queries of the operators on file contents; their inputs are built from the driver's tables."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from dataclasses import asdict
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert, media, skeleton
from ..functions.pieces import in_pieces
from ..sources import archives
from .arguments import Render
from .bundle import failures_of, prepare, render_items, report_totals
from .catalog import lines_sql, newline_sql, query, read, tokens_sql
from .templates import Template


def _files(df, make, key: str):
    """(key, path, abs_path, content) with make(key, text) -> (path, bytes), built by the executors."""
    names = df.columns

    def file(i, text):
        path, data = make(i, text or "")
        return path, path, data

    def run(batches):
        yield from in_pieces(batches, names, file, pa.schema([("path", pa.string()), ("abs_path", pa.string()), ("content", pa.binary())]), [key])

    return df.mapInArrow(run, f"{key} long, path string, abs_path string, content binary")


def _archive(i: int, text: str) -> tuple[str, bytes]:
    data = text.encode()
    if i % 2:
        return f"{i}.txt.gz", gzip.compress(data, 1, mtime=0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("d/a.txt"), data)
        z.writestr(zipfile.ZipInfo("../b.txt"), data)
        z.writestr(zipfile.ZipInfo(f"{i}.txt"), data[:10])
    return f"{i}.zip", out.getvalue()


@query(
    "archive_entries",
    """SELECT doc_id || '.txt.gz/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id || '.zip/d/a.txt', octet_length(encode(text))::BIGINT, sha256(text) FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id || '.zip/' || doc_id || '.txt', least(10, octet_length(encode(text)))::BIGINT, sha256(encode(text)[1:10]) FROM documents WHERE doc_id % 2 = 0""",
)
def archive_entries(spark, sf_dir):
    packed = _files(read(spark, sf_dir, "documents").select("doc_id", "text"), _archive, "doc_id")
    return archives.expand_archives(packed).select("path", "size", F.sha2("content", 256).alias("sha"))


def _docx(i: int, text: str) -> tuple[str, bytes]:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), "<w:d xmlns:w='w'>" + "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n")) + "</w:d>")
    return f"{i}.docx", out.getvalue()


@query("document_text", "SELECT doc_id, text || chr(10) AS converted_text FROM documents")
def document_text(spark, sf_dir):
    files = _files(read(spark, sf_dir, "documents").select("doc_id", "text"), _docx, "doc_id").withColumn("document_kind", F.lit("docx"))
    return convert.convert_documents(files).select("doc_id", "converted_text")


#: The tables' pages are of one kind: a heading and paragraphs, some of them unclosed, beside a menu, an advert and a footer.
PAGE_BLOCKS = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<head.*?</head>|<nav.*?</nav>|<footer.*?</footer>|<script.*?</script>|<style.*?</style>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<h1[^>]*>', chr(1) || '# ', 'g'), '<p>|</p>|</h1>', chr(1), 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM c)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) || chr(10) AS markdown FROM d
"""


@query("html_to_markdown", PAGE_BLOCKS)
def html_to_markdown(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select("page_id", F.lit("html").alias("document_kind"), F.col("html").cast("binary").alias("content"))
    return convert.convert_documents(files).select("page_id", F.col("converted_text").alias("markdown"))


def _media(i: int, text: str) -> tuple[str, bytes]:
    """A file of one of five picture formats, sized as the text is, often under another format's name; or the text itself."""
    width, height = len(text.encode()) % 5000 + 1, len(text) % 3000 + 1
    kind = i % 6
    if kind == 0:
        head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
        return f"{i}.jpg", b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))
    if kind == 1:
        frame = b"\x21\xf9\x04\x00" + struct.pack("<H", 20) + b"\x00\x00\x2c" + struct.pack("<HHHHB", 0, 0, 4, 3, 0) + b"\x02\x01\x00\x00"
        return f"{i}.gif", b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80, 0, 0) + b"\0" * 6 + frame * (i % 4 + 1) + b"\x3b"
    if kind == 2:
        return f"{i}.bmp", b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, width, -height, 1, 24) + b"\0" * 30
    if kind == 3:
        return f"{i}.png", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 9
    if kind == 4:
        return f"{i}.tif", b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, width, 0) + struct.pack(">HHII", 257, 4, 1, height)
    return f"{i}.txt", text.encode()


@query(
    "media_metadata",
    """WITH m AS (SELECT doc_id, doc_id % 6 AS kind, octet_length(encode(text)) % 5000 + 1 || 'x' || (length(text) % 3000 + 1) AS size, doc_id % 4 + 1 AS frames FROM documents),
    n AS (SELECT *, CASE WHEN kind < 5 THEN ['png', 'gif', 'bmp', 'jpeg', 'tiff'][kind::INT + 1] END AS media_format FROM m)
    SELECT doc_id, media_format, 'Container: ' || media_format || chr(10) || CASE WHEN kind = 1 AND frames > 1 THEN 'Duration: 00:00:00.' || frames * 2 || '00' || chr(10) ELSE '' END || 'Image: ' || size
      || CASE kind WHEN 0 THEN ', rgba, 8-bit' WHEN 1 THEN ', indexed, 1-bit' || CASE WHEN frames > 1 THEN ', ' || frames || ' frames' ELSE '' END WHEN 2 THEN ', rgb, 24-bit' WHEN 3 THEN ', ycbcr, 8-bit' ELSE ', rgb' END
      || chr(10) AS media_text FROM n""",
)
def media_metadata(spark, sf_dir):
    files = _files(read(spark, sf_dir, "documents").select("doc_id", "text"), _media, "doc_id")
    return media.describe_media(files).select("doc_id", "media_format", "media_text")


#: Sources by doc_id % 4; {i}, {n} and {t} are a document's id, its length and the plain characters of its first line.
SOURCES = (
    ("python", "# {t}\ndef f{i}(a, b={n}):\n    '''Adds.'''\n    return a + b\n\n\ndef _g():\n    pass\n\n\nclass K:\n    size = {n}\n\n    def m(self):\n        return 1\n"),
    ("go", "package p{i}\n\n// {t}\ntype Box{i} struct {\n\tName string\n\tsize int\n}\n\n// F adds.\nfunc F{i}(a int) int {\n\treturn a + {n}\n}\n\nfunc hidden() {}\n"),
    ("typescript", "/** {t} */\nexport interface S{i} {\n    area(): number;\n    label: string;\n}\n\nexport function f{i}(a: number): number {\n    if (a) { return {n}; }\n    return a;\n}\nconst limit = {n};\n"),
    ("rust", "/// {t}\npub struct U{i} {\n    pub name: String,\n    mail: String,\n}\n\n/// Adds.\npub fn f{i}(a: u32) -> u32 {\n    a + {n}\n}\n\nfn hidden() {}\n"),
)
PYTHON_FUNCTIONS = "# {t}\ndef f{i}(a, b={n}):\n    '''Adds.'''\n...\nclass K:\n...\n    def m(self):\n"
KEPT = {
    "functions": (PYTHON_FUNCTIONS, "// F adds.\nfunc F{i}(a int) int {\n", "/** {t} */\nexport interface S{i} {\n    area(): number;\n...\n}\n...\nexport function f{i}(a: number): number {\n", "/// Adds.\npub fn f{i}(a: u32) -> u32 {\n"),
    "types": ("class K:\n    size = {n}\n", "// {t}\ntype Box{i} struct {\n\tName string\n...\n}\n", "/** {t} */\nexport interface S{i} {\n...\n    label: string;\n}\n", "/// {t}\npub struct U{i} {\n    pub name: String,\n...\n}\n"),
    "both": (
        PYTHON_FUNCTIONS.replace("class K:\n...", "class K:\n    size = {n}\n..."), "// {t}\ntype Box{i} struct {\n\tName string\n...\n}\n...\n// F adds.\nfunc F{i}(a int) int {\n",
        "/** {t} */\nexport interface S{i} {\n    area(): number;\n    label: string;\n}\n...\nexport function f{i}(a: number): number {\n", "/// {t}\npub struct U{i} {\n    pub name: String,\n...\n}\n...\n/// Adds.\npub fn f{i}(a: u32) -> u32 {\n",
    ),
}
FIRST_LINE = r"regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z .,]', '', 'g')"


def _filled(texts) -> Column:
    """The text of a document's kind with its values in it."""
    text = F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col("doc_id"), F.lit(len(texts))) + 1).cast("int"))
    first = F.regexp_replace(F.substring_index("text", "\n", 1), "[^A-Za-z .,]", "")
    for sign, column in (("{i}", F.col("doc_id").cast("string")), ("{n}", F.col("n_chars").cast("string")), ("{t}", first)):
        text = F.replace(text, F.lit(sign), column)
    return text


def _fill(texts) -> str:
    quoted = ["'" + t.replace("'", "''") + "'" for t in texts]
    return f"replace(replace(replace([{', '.join(quoted)}][(doc_id % {len(quoted)})::INT + 1], '{{i}}', doc_id::VARCHAR), '{{n}}', n_chars::VARCHAR), '{{t}}', {FIRST_LINE})"


for _mode in KEPT:

    @query(f"skeleton_{_mode}", f"SELECT doc_id, {_fill(KEPT[_mode])} AS skeleton FROM documents")
    def skeleton_query(spark, sf_dir, mode=_mode):
        language = F.element_at(F.array(*[F.lit(name) for name, _ in SOURCES]), (F.pmod(F.col("doc_id"), F.lit(len(SOURCES))) + 1).cast("int"))
        rows = read(spark, sf_dir, "documents").select("doc_id", language.alias("language"), _filled([t for _, t in SOURCES]).alias("text"))
        return skeleton.skeletons(rows, mode != "types", mode != "functions").select("doc_id", "skeleton")


SLICE = "# {t}\ndef f{i}(a, b={n}):\n... (11 rows skipped)\n    def m(self):\n"


def _prepared(rows, render: Render, key: str, wanted: str):
    """Columns of the content step of files (key, path, content)."""
    names = [c.split()[0] for c in wanted.split(", ")]
    blank = dict.fromkeys(("abs_path", "media_type", "failure")) | {"render": asdict(render)}

    def prepared(path, content):
        done = prepare(blank | {"path": path, "content": content, "size": len(content)}, False)
        return tuple(done[n] for n in names)

    def run(batches):
        yield from in_pieces(batches, ["path", "content"], prepared, pa.schema([(n, pa.string()) for n in names]), [key])

    return rows.mapInArrow(run, f"{key} long, {wanted}")


@query("skeleton_slice", f"SELECT doc_id, {_fill([SLICE])} AS text FROM documents")
def skeleton_slice(spark, sf_dir):
    text = _filled([SOURCES[0][1]])
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit("a.py").alias("path"), text.cast("binary").alias("content"))
    return _prepared(rows, Render(head=2, tail=1, functions=True, types=True), "doc_id", "text string")


def _mixed(i: int, text: str) -> tuple[str, bytes]:
    """A page as it is, as a paragraph of a DOCX file, as a broken PDF file, or as plain text."""
    kind = i % 4
    return (f"{i}.html", text.encode()) if kind == 0 else _docx(i, text) if kind == 1 else (f"{i}.pdf", text.encode()) if kind == 2 else (f"{i}.txt", text.encode())


@query(
    "converted_from",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'docx' END AS converted_from, CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 3 THEN 'text' ELSE '' END AS language,
    CASE page_id % 4 WHEN 1 THEN html || chr(10) WHEN 0 THEN NULL ELSE CASE WHEN right(html, 1) = chr(10) THEN html ELSE html || chr(10) END END AS text FROM pages""",
)
def converted_from(spark, sf_dir):
    files = _files(read(spark, sf_dir, "pages").select("page_id", "html"), _mixed, "page_id").select("page_id", "path", "content")
    done = _prepared(files, Render(documents=True), "page_id", "converted_from string, language string, text string")
    return done.withColumn("text", F.when(F.col("page_id") % 4 != 0, F.col("text")))


@query("template_render", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'long ' ELSE 'short ' END || source || ' ' || format('{:,}', n_chars) AS rendered FROM documents")
def template_render(spark, sf_dir):
    source = "{{ if gt .N 1000 }}long{{ else }}short{{ end }} {{ .Source }} {{ .N | commafy }}"

    def run(batches):
        made = Template(source)
        for batch in batches:
            out = [made({"N": n, "Source": s}) for n, s in zip(batch.column("n_chars").to_pylist(), batch.column("source").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "rendered"])

    return read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").mapInArrow(run, "doc_id long, rendered string")


#: Of the documents as files, some begin with a zero byte, some could not be listed, and some are gone when they are read.
BINARY, UNLISTED, GONE = "doc_id % 11 = 3", "doc_id % 13 = 5", "doc_id % 17 = 7"


def _items(spark, sf_dir) -> DataFrame:
    """Documents as the items of a bundle, in the order of their ids."""
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    data = F.when(F.expr(BINARY), F.concat(F.lit(b"\0"), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8"))
    options = F.struct(*[F.lit(v).cast("boolean" if isinstance(v, bool) else "long").alias(k) for k, v in asdict(Render()).items()])
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("position"), F.when(F.expr(UNLISTED), "failure").otherwise("file").alias("kind"), none("body"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("/nowhere/at/all").alias("abs_path"), none("archive"), none("entry"), F.octet_length("text").cast("long").alias("size"), F.when(~F.expr(f"{UNLISTED} OR {GONE}"), data).alias("content"),
        none("media_type"), F.when(F.expr(UNLISTED), "stat: permission denied").alias("failure"), options.alias("render"), none("fields", "map<string,string>"),
    )


@query("failures", f"SELECT doc_id AS position, doc_id || '.txt' AS path, CASE WHEN {UNLISTED} THEN 'stat: permission denied' ELSE 'no such file or directory' END AS failure FROM documents WHERE {UNLISTED} OR {GONE}")
def failures(spark, sf_dir):
    return failures_of(render_items(_items(spark, sf_dir)))


@query(
    "report",
    f"""WITH f AS (SELECT doc_id, text, {UNLISTED} AS unlisted, NOT ({UNLISTED}) AND {GONE} AS gone, NOT ({UNLISTED} OR {GONE}) AND {BINARY} AS is_binary FROM documents),
    r AS (SELECT *, CASE WHEN NOT (unlisted OR gone OR is_binary) THEN {newline_sql('text')} ELSE '' END AS item FROM f)
    SELECT count(*) FILTER (NOT unlisted) AS total_files, sum(CASE WHEN item <> '' THEN {lines_sql('text')} ELSE 0 END)::BIGINT AS total_rows, count(*) FILTER (is_binary) AS binary_files,
    count(*) FILTER (unlisted OR gone) AS failed_files, sum(octet_length(encode(item)))::BIGINT AS written_bytes, sum({tokens_sql('item')})::BIGINT AS written_tokens FROM r""",
)
def report(spark, sf_dir):
    return report_totals(render_items(_items(spark, sf_dir), "bare"), False)
