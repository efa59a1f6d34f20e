"""Bundles: ordered items (files, sections, prompts, trees, system contexts) rendered to one document.

Inputs are listed on the driver (names and sizes) or come as a table; contents are read, converted, reduced and rendered
by the executors, one narrow step per file.  Positions, indices and totals are DataFrame operations on names and sizes.
The document is written in order without being held anywhere: through the driver, row by row, or as ordered part files.
"""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, names, skeleton
from ..functions.convert import document_text
from ..functions.text import size_tokens, token_estimate
from ..operators import sections as layout
from ..operators import tree
from ..operators.lineage import numbered
from ..sources import archives, inputs
from ..sources.walk import read_stream
from ..sources.web import fetch
from .arguments import Parsed, Render, Section, compile_sections, parse
from .profiles import profile_for
from .templates import STATS_FUNCTIONS, Template, compile_templates

VERSION = "1"
RENDER = "struct<head:long,tail:long,numbers:boolean,max_size:long,functions:boolean,types:boolean,documents:boolean,media:boolean>"
ITEMS = f"position long, kind string, body string, path string, abs_path string, archive string, entry string, size long, content binary, media_type string, failure string, render {RENDER}, fields map<string,string>"
#: What a file's content step adds to its item.
PREPARED = "language string, text string, rows long, is_binary boolean, is_image boolean, is_compact boolean, read_error string, skeleton_mode string, data_uri string, converted_from string, original_size long, shown_size long, is_estimate boolean"
DEFAULT_STATS = (
    '{{ accent .ColorEnabled "▎" }} {{ commafy .Global.TotalFiles }} {{ plural .Global.TotalFiles "file" "files" }} {{ dim .ColorEnabled "·" }} '
    '{{ commafy .Global.TotalRows }} {{ plural .Global.TotalRows "row" "rows" }} {{ dim .ColorEnabled "·" }} {{ commafy .Global.TotalSections }} '
    '{{ plural .Global.TotalSections "section" "sections" }}{{ if not .Global.SizeUnknown }} {{ dim .ColorEnabled "·" }} {{ humanize .Global.TotalSize }}{{ end }}\n'
    "  {{ tokenLabel .Global.WrittenTokenEstimate .ColorEnabled }}\n"
)


# One file's content, on an executor


def count_rows(text: str) -> int:
    return text.count("\n") + (1 if text and not text.endswith("\n") else 0)


# Bytes up to which rows of a partly shown file are counted, and the part that larger ones are judged by.
COUNTED, JUDGED = 64 << 20, 64 << 10


def estimated_rows(data: bytes) -> int | None:
    """Rows by the line length of the first part; None for data that is small enough to count."""
    if len(data) <= COUNTED:
        return None
    ends = data[:JUDGED].count(b"\n")
    return len(data) * ends // JUDGED if ends else 1


def numbered_lines(lines: list[tuple[int, str]], width: int) -> str:
    """Lines with their rows in front; row 0 is a marker without one."""
    return "".join(f"{row:>{width}}: {line}\n" if row else f"{line}\n" for row, line in lines)


def shows_all(render: Render, lines: int) -> bool:
    return (render.head < 0 and not render.tail) or render.head < 0 <= render.tail or render.head + max(render.tail, 0) >= lines


def sliced(text: str, render: Render, kept: list | None, estimated: int | None = None) -> str:
    """Head, tail or both of a text, or of its skeleton's lines; a gap says how many source rows (of about `estimated`) it leaves out."""
    total = count_rows(text)
    width = len(str(max(total, 1)))
    raw = text.split("\n")
    lines = [(i + 1, x) for i, x in enumerate(raw[:-1] if text.endswith("\n") or not text else raw)] if kept is None else kept
    head, tail = render.head, max(render.tail, 0)
    ended = kept is not None or text.endswith("\n") or not text

    def written(part, last: bool) -> str:
        out = numbered_lines(part, width) if render.numbers else "".join(line + "\n" for _, line in part)
        return out if ended or not last else out.removesuffix("\n")

    if shows_all(render, len(lines)):
        return written(lines, False) if lines else ""
    top, bottom = lines[:head], lines[len(lines) - tail :] if tail else []
    gap = ""
    if top and bottom:
        first = next((r for r, _ in bottom if r), total)
        skipped = first - 1 - next((r for r, _ in reversed(top) if r), 0) if kept is not None else len(lines) - head - tail
        gap = f"... ({skipped} rows skipped)\n" if estimated is None else f"... (~{estimated - len(top) - len(bottom)} rows skipped)\n"
    return written(top, not bottom) + gap + written(bottom, True)


def prepare(row: dict, embeds: bool, last: archives.LastArchive | None = None) -> dict:
    """Reads, classifies, converts, reduces and slices one file; a failure ends in read_error.

    `last` keeps the archive that the task's files come from, so that neighbours read it once.
    """
    render, path = Render(**row["render"]), row["path"] or ""
    out = dict.fromkeys((c.split()[0] for c in PREPARED.split(", ")))
    out |= {"language": "", "text": "", "rows": 0, "is_estimate": False, "is_binary": False, "is_image": False, "is_compact": False, "original_size": row["size"], "shown_size": row["size"]}
    data, failure = row["content"], row["failure"]
    if data is None and not failure:
        if row["abs_path"].startswith(("http://", "https://")):
            try:
                data, row["media_type"] = fetch(row["abs_path"])
            except (OSError, ValueError) as error:
                failure = f"url: {error}"
        elif row.get("archive"):
            data, failure = (last or archives.LastArchive()).content(row["archive"], row["entry"], render.max_size)
        else:
            data, failure = read_stream(row["abs_path"], render.max_size)
    if failure:
        return out | {"read_error": failure.partition(": ")[2] or failure}
    data = bytes(data)
    out |= {"original_size": len(data), "shown_size": len(data)}
    kind = media.classify(path, data[: media.HEAD])
    image = kind in names.FORMATS and names.FORMATS[kind][1] == "image" or kind in ("jpeg", "tiff")
    suffix = path.rpartition(".")[2].lower()
    bare = (row["media_type"] or "").partition(";")[0].strip().lower()
    document = "html" if suffix in ("html", "htm", "xhtml") or bare in ("text/html", "application/xhtml+xml") else suffix if suffix in ("pdf", "docx", "xlsx", "pptx") else names.DOCUMENT_TYPES.get(bare, "")[1:]
    language = None
    if render.documents and document:
        try:
            data = document_text(document, data).encode("utf-8", "replace")
            out |= {"converted_from": document, "shown_size": len(data)}
            language, kind, image = ("markdown" if document == "html" else ""), "", False
        except ValueError:
            pass  # the raw content stays
    elif render.media and kind in media.PARSERS and not (image and embeds):
        if (text := media.metadata(kind, data)) is not None:
            data, image = text.encode(), False
            out |= {"converted_from": kind, "shown_size": len(data)}
    out["is_binary"], out["is_image"] = media.looks_binary(data), image
    if image and embeds:
        import base64

        mime = next((v[2] for v in names.FORMATS.values() if v[0] == kind), "application/octet-stream")
        out["data_uri"] = f"data:{mime};base64,{base64.b64encode(data).decode()}"
    text = "" if out["is_binary"] else data.decode("utf-8", "replace")
    out["language"] = names.language_of(path, text) if language is None else language
    out["rows"] = count_rows(text)
    kept = guess = None
    if not out["is_binary"] and not image:
        ranges = skeleton.skeleton_rows(out["language"], text, render.functions, render.types, path)
        if ranges is not None:
            kept = skeleton.skeleton_lines(ranges, text.removesuffix("\n").split("\n"))
            out |= {"skeleton_mode": skeleton.mode_label(render.functions, render.types), "shown_size": sum(len(x.encode()) + 1 for _, x in kept)}
    nothing = render.head == 0 and render.tail == 0
    out["is_compact"] = nothing or out["is_binary"] or out["shown_size"] == 0
    if kept is None and not out["is_binary"] and not shows_all(render, out["rows"]) and (guess := estimated_rows(data)) is not None:
        out |= {"rows": guess, "is_estimate": True}
    if not out["is_compact"]:
        out["text"] = sliced(text, render, kept, guess)
    return out


# The bundle


@dataclass
class Bundle:
    """Built by from_arguments(), or item by item with add(), prompt(), section(), tree() and context()."""

    spark: SparkSession
    cwd: str = field(default_factory=os.getcwd)
    profile: str = "markdown"
    config: dict = field(default_factory=dict)
    fetcher: object = fetch
    rows: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    skipped_by_size: int = 0
    output: str = ""
    settings: dict[str, str] = field(default_factory=dict)
    #: Estimators of tokens, by text and by size alone: Column to Column.
    tokenizer: Callable = token_estimate
    size_tokenizer: Callable = size_tokens

    @classmethod
    def from_arguments(cls, spark, arguments: list[str], cwd: str | None = None, stdin: bytes | None = None, config: dict | None = None, **options) -> Bundle:
        """As the command line gives them; piped paths count where no file is named, else the working directory."""
        parsed: Parsed = parse(arguments)
        made, warnings = compile_sections(parsed.ops)
        bundle = cls(spark, cwd or os.getcwd(), config=config or {}, warnings=warnings, settings=parsed.settings, **options)
        formats = [op.name for op in parsed.ops if op.name in ("md", "xml", "html", "bare")]
        bundle.profile = {"md": "markdown"}.get(formats[-1], formats[-1]) if formats else bundle.config.get("output_format") or "markdown"
        bundle.output = os.path.normpath(os.path.join(bundle.cwd, parsed.settings["output"])) if parsed.settings.get("output") else ""
        compile_templates(bundle.config)
        from .arguments import Item

        has_files = any(i.kind in ("file", "stdin") for s in made for i in s.items)
        piped = inputs.path_list(stdin, "null" in parsed.settings) if stdin is not None and not has_files else []
        if not has_files and (piped or not any(s.items for s in made)):
            section = made[-1] if made else compile_sections([*parsed.ops, *parse(["."]).ops])[0][-1]
            section.items = [i for i in section.items if i.kind != "file"] + [Item("file", p) for p in (piped or ["."])]
            made = made or [section]
        seen: set[str] | None = set() if piped else None
        for section in made:
            bundle._section(section, arguments, stdin, seen)
        return bundle

    def _section(self, section: Section, arguments, stdin, seen) -> None:
        from dataclasses import replace

        options = replace(section.options, output=self.output)
        found = {}
        for place, item in enumerate(section.items):
            if item.kind == "file":
                got = inputs.collect(item.value, options, section.render.max_size, self.cwd, seen is not None, self.fetcher)
                found[place] = [i for i in got if seen is None or not (i.key in seen or seen.add(i.key))]
            elif item.kind == "stdin":
                found[place] = [inputs.standard_input(stdin or b"", section.render.max_size)]
        for place, item in enumerate(section.items):
            if item.kind in ("file", "stdin"):
                for i in found[place]:
                    if i.failure:
                        self.failure(i)
                    elif not item.tree_only:
                        self.add_input(i, section.render)
            elif item.kind == "tree":
                self.tree([i.path for p in item.covers for i in found[p] if not i.failure and not self._too_large(i, section.render)])
            elif item.kind == "section":
                self.section(item.value)
            elif item.kind == "meta":
                self.context(arguments)
            elif item.kind == "prompt":
                self.prompt(item.value)
            else:
                path = inputs.find_prompt(item.value, self.settings.get("prompts-dir") or self.config.get("prompts_dir", ""))
                with open(os.path.join(self.cwd, path), encoding="utf-8") as f:
                    self.prompt(f.read())

    @staticmethod
    def _too_large(i, render: Render) -> bool:
        return 0 < render.max_size < i.size

    def _push(self, kind: str, render: Render = Render(), **values) -> None:
        row = dict.fromkeys(("body", "path", "abs_path", "archive", "entry", "size", "content", "media_type", "failure", "fields"))
        self.rows.append(row | {"position": len(self.rows) + 1, "kind": kind, "render": asdict(render)} | values)

    def add(self, target: str, render: Render = Render(), options=None) -> Bundle:
        from ..sources.walk import Options

        for i in inputs.collect(target, options or Options(), render.max_size, self.cwd, fetcher=self.fetcher):
            self.failure(i) if i.failure else self.add_input(i, render)
        return self

    def add_input(self, i, render: Render = Render()) -> Bundle:
        if self._too_large(i, render):
            self.skipped_by_size += 1
        else:
            self._push("file", render, path=i.path, abs_path=i.abs_path, archive=i.archive, entry=i.entry, size=i.size, content=i.content, media_type=i.media_type)
        return self

    def failure(self, i) -> Bundle:
        self._push("failure", path=i.path, failure=i.failure)
        return self

    def section(self, title: str) -> Bundle:
        self._push("section", body=title)
        return self

    def prompt(self, text: str) -> Bundle:
        self._push("prompt", body=text)
        return self

    def tree(self, paths: list[str]) -> Bundle:
        self._push("tree", body=tree_text(self.spark, paths))
        return self

    def context(self, arguments: list[str], now: datetime | None = None) -> Bundle:
        fields = inputs.system_context(arguments, VERSION, now or datetime.now(UTC).astimezone())
        self._push("meta", body=inputs.context_body(fields), fields=fields)
        return self

    # Plans and results

    def items(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEMS.split(", ")) for r in self.rows], ITEMS)

    def plan(self) -> DataFrame:
        """Totals from names and sizes only: total_files, total_size, size_unknown, token_estimate."""
        return layout.plan_totals(self.items(), self.size_tokenizer)

    def failures(self) -> DataFrame:
        """What could not be read, in output order: found while listing, or while reading."""
        return failures_of(self.rendered()).orderBy("position")

    def rendered(self) -> DataFrame:
        """Items with their place, section, indices, state and text `item`, unordered; order by position."""
        return render_items(self.items(), self.profile, self.config, self.plan(), self.skipped_by_size, self.tokenizer)

    def pieces(self) -> Iterator[tuple[str, int, dict]]:
        """(text, tokens, row) of everything that is written, in order; one row is on the driver at a time."""
        return write_pieces(self.rendered(), self.profile, self.config, self.plan().first().asDict() | {"skipped_by_size": self.skipped_by_size}, self.tokenizer)

    def text(self) -> str:
        return "".join(text for text, _, _ in self.pieces())

    def write(self, path: str | None = None, to=None, also=None, on_failure=lambda path, failure: None) -> dict:
        """Writes the document to a file (replaced only on success) or to a text stream; returns the report.

        `also` is a function that gets the whole document instead, as a clipboard needs it; `on_failure` is called for
        each input that could not be read, in order.
        """
        report = {"TotalRows": 0, "BinaryFiles": 0, "FailedFiles": 0, "TotalWrittenBytes": 0, "WrittenTokenEstimate": 0, "TotalSections": 0, "SkippedBySize": self.skipped_by_size}
        path = path or self.output
        target = tempfile.NamedTemporaryFile("wb", dir=os.path.dirname(path) or ".", delete=False) if path else None
        held: list[str] = []
        say = held.append if also else (to or sys.stdout).write
        seen: set[int] = set()
        try:
            for text, tokens, row in self.pieces():
                data = text.encode("utf-8", "replace")
                target.write(data) if target else say(text)
                report["TotalWrittenBytes"] += len(data)
                report["WrittenTokenEstimate"] += tokens
                if row:
                    seen.add(row["section"])
                    report["TotalRows"] += row["rows"] or 0
                    report["BinaryFiles"] += bool(row["is_binary"])
                    if row["kind"] == "failure" or row["read_error"] is not None:
                        report["FailedFiles"] += 1
                        on_failure(row["path"], row["failure"] or row["read_error"])
            if path:
                target.close()
                os.replace(target.name, path)
        except BaseException:
            if path:
                target.close()
                os.unlink(target.name)
            raise
        if also:
            also("".join(held))
        totals = self.plan().first()
        return report | {"TotalFiles": totals["total_files"], "TotalSize": totals["total_size"], "SizeUnknown": totals["size_unknown"], "TokenEstimate": totals["token_estimate"], "TotalSections": len(seen)}

    def report(self) -> DataFrame:
        """One row: what write() reports about the items, without writing them."""
        return report_totals(self.rendered(), self.config.get("separators", profile_for(self.profile).separators))

    def write_parts(self, folder: str) -> None:
        """The items with their separators as text part files, whose order is the document's; nothing passes the driver."""
        rows = layout.separators(self.rendered().where("kind != 'failure'"))
        out = rows.select("position", F.concat("sep_before", "item").alias("value"))
        out.repartitionByRange("position").sortWithinPartitions("position").select("value").write.option("lineSep", "\n").text(folder)


def items_of_files(files: DataFrame, render: Render = Render()) -> DataFrame:
    """Items (ITEMS) of a table of files as walk_files() gives it, in walk order, without listing them on the driver.

    Files over the size limit are left out; what could not be listed becomes a failure.
    """
    if render.max_size > 0:
        files = files.where((F.col("size") <= render.max_size) | F.col("failure").isNotNull())
    rows = numbered(files.withColumn("_key", F.split("path", "/")), [F.col("_key"), F.col("abs_path")], "position")
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    options = F.struct(*[F.lit(v).cast("boolean" if isinstance(v, bool) else "long").alias(k) for k, v in asdict(render).items()])
    return rows.select(
        "position", F.when(F.col("failure").isNull(), "file").otherwise("failure").alias("kind"), none("body"), "path", "abs_path", none("archive"), none("entry"), "size",
        none("content", "binary"), none("media_type"), "failure", options.alias("render"), none("fields", "map<string,string>"),
    )


def failures_of(rendered: DataFrame) -> DataFrame:
    """position, path, failure of what could not be listed or read."""
    return rendered.where("kind = 'failure' OR read_error IS NOT NULL").select("position", "path", F.coalesce("failure", "read_error").alias("failure"))


def report_totals(rendered: DataFrame, separators: bool) -> DataFrame:
    """One row of totals over rendered items: files, rows, binary and failed ones, bytes and tokens of the items (bytes with their separators)."""
    failed = (F.col("kind") == "failure") | F.col("read_error").isNotNull()
    written = layout.separators(rendered.where("kind != 'failure'")) if separators else rendered.where("kind != 'failure'").withColumn("sep_before", F.lit(""))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("long")
    counts = rendered.agg(
        F.count_if(F.col("kind") == "file").alias("total_files"), total(F.when(F.col("kind") == "file", F.col("rows"))).alias("total_rows"),
        F.count_if(F.coalesce("is_binary", F.lit(False))).alias("binary_files"), F.count_if(failed).alias("failed_files"),
    )
    size = F.octet_length("sep_before") + F.octet_length("item")
    return counts.crossJoin(written.agg(total(size).alias("written_bytes"), total("tokens").alias("written_tokens")))


def tree_text(spark: SparkSession, paths: list[str]) -> str:
    """The drawing of a list of paths."""
    if not paths:
        return ""
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    drawn = tree.tree_lines(tree.tree_nodes(table.select(tree.path_parts(F.col("path")).alias("parts"))))
    return "".join(r["line"] + "\n" for r in drawn.orderBy("place").toLocalIterator())


def render_items(items: DataFrame, profile: str = "markdown", config: dict | None = None, plan: DataFrame | None = None, skipped: int = 0, tokenizer: Callable = token_estimate) -> DataFrame:
    """Items (ITEMS) with everything that templates see, their text `item`, what their section has around it, and the tokens of each."""
    config = config or {}
    p = profile_for(profile)
    embeds = config.get("embed_images", p.embeds_images)
    placed = layout.with_sections(items.drop("content", "failure"), [F.col("position")])
    indexed = layout.with_file_index(placed)
    # Titles open sections; what is left out of the document still has a place in its order.
    places = indexed.select("position", "item_seq", "section", "is_implicit", "file_index", "section_file_index", "section_files", "section_size")

    def run(batches):
        last = archives.LastArchive()
        for batch in batches:
            for row in batch.to_pylist():  # a file's content is held one at a time
                done = prepare(dict(row), embeds, last) if row["kind"] == "file" else dict.fromkeys(c.split()[0] for c in PREPARED.split(", "))
                one = pa.RecordBatch.from_pylist([{k: v for k, v in row.items() if k != "content"}], schema=pa.schema([f for f in batch.schema if f.name != "content"]))
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([done[n.split()[0]]], _ARROW[n.split()[1]]) for n in PREPARED.split(", "))], [*one.schema.names, *(n.split()[0] for n in PREPARED.split(", "))])

    schema = ITEMS.replace("content binary, ", "") + ", " + PREPARED
    ready = items.mapInArrow(run, schema).join(places, "position")
    totals = (plan if plan is not None else layout.plan_totals(items)).crossJoin(placed.agg(F.coalesce(F.max("section") + 1, F.lit(0)).alias("total_sections")))
    ready = ready.join(F.broadcast(totals), how="cross").withColumns({"content": F.col("text"), "is_estimate": F.coalesce("is_estimate", F.lit(False)), "listed_size": F.col("size"), "skipped_by_size": F.lit(skipped).cast("long")})
    ready = ready.withColumns({"size": F.coalesce("shown_size", "size"), "is_compact": F.coalesce("is_compact", F.lit(False))})
    custom = compile_templates(config)
    built_in = (
        F.when(F.col("kind") == "file", p.file()).when(F.col("kind") == "prompt", p.prompt()).when(F.col("kind") == "tree", p.tree())
        .when(F.col("kind") == "meta", p.meta()).when(F.col("kind") == "section", F.concat(p.section_header(), p.section())).otherwise("")
    )
    out = ready.withColumns({"item": built_in, "section_top": p.section_header(), "section_foot": p.section_footer()})
    if custom:
        asked = any("TokenEstimate" in str(x) for x in config.values())
        out = out.withColumn("content_tokens", F.transform(F.array(F.coalesce("content", F.lit(""))), tokenizer)[0] if asked else F.lit(0).cast("long"))
        out = _with_templates(out, config)
    # Inside a lambda the two short texts add no code to the stage, which has to stay small enough to be compiled.
    around = F.transform(F.array("section_top", "section_foot"), tokenizer)
    return out.withColumn("tokens", tokenizer(F.col("item"))).withColumns({"top_tokens": around[0], "foot_tokens": around[1]})


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def template_context(r: dict) -> dict:
    plan = {"TotalFiles": r["total_files"], "TotalSize": r["total_size"], "SizeUnknown": r["size_unknown"], "TokenEstimate": r["token_estimate"], "TotalSections": r["total_sections"], "SkippedBySize": r["skipped_by_size"]}
    section = {"Body": r["body"] if r["kind"] == "section" else "", "Index": r["section"], "TotalFiles": r["section_files"] or 0, "TotalSize": r["section_size"] or 0, "Global": plan, "IsImplicit": r["is_implicit"]}
    if r["kind"] == "section":
        return section
    if r["kind"] != "file":
        return {"Body": r["body"] or "", "Fields": dict(r["fields"] or {}), "Global": plan, "Section": section}
    return {
        "Path": r["path"], "AbsPath": r["abs_path"], "Archive": r["archive"] or "", "Entry": r["entry"] or "", "Size": r["size"], "OriginalSize": r["original_size"], "ModTime": None,
        "TotalRows": r["rows"], "ReadError": r["read_error"] or "", "IsError": r["read_error"] is not None, "IsEstimate": r["is_estimate"], "Language": r["language"], "Content": r["text"],
        "IsBinary": r["is_binary"], "IsImage": r["is_image"], "DataURI": r["data_uri"] or "", "IsCompactView": r["is_compact"], "FileIndex": r["file_index"],
        "SectionFileIndex": r["section_file_index"], "SkeletonMode": r["skeleton_mode"] or "", "ConvertedFrom": r["converted_from"] or "", "TokenEstimate": r["content_tokens"], "Global": plan, "Section": section,
    }


def _with_templates(rows: DataFrame, config: dict) -> DataFrame:
    """Replaces the text of items whose template the configuration sets."""

    def run(batches):
        made = compile_templates(config)
        for batch in batches:
            texts, around = [], {"section_top": [], "section_foot": []}
            for r in batch.to_pylist():
                for column, own in (("section_top", "section_header"), ("section_foot", "section_footer")):
                    around[column].append(made[own](template_context(r | {"kind": "section"})) if own in made else r[column])
                name = r["kind"]
                if name == "file":
                    name = "file_" + ("error" if r["read_error"] is not None else "image" if r["is_image"] else "binary" if r["is_binary"] else "compact" if r["is_compact"] else "content")
                texts.append(made[name](template_context(r)) if name in made else r["item"])
            new = around | {"item": texts}
            columns = [pa.array(new[n], pa.string()) if n in new else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def write_pieces(rendered: DataFrame, profile: str, config: dict, totals: dict, tokenizer: Callable = token_estimate) -> Iterator[tuple[str, int, dict]]:
    """Header, items in order with separators and section wrappers, footer; tokens are estimated per piece.

    All texts and estimates are columns: one job for the items, one for what stands at the ends, however many sections there are.
    """
    p, custom = profile_for(profile), compile_templates(config)
    separators = config.get("separators", p.separators)
    rows = rendered.orderBy("position").toLocalIterator()
    first = next(rows, None)
    totals = {"skipped_by_size": 0} | totals | {"total_sections": first["total_sections"] if first else 0}
    global_ = {"TotalFiles": totals["total_files"], "TotalSize": totals["total_size"], "SizeUnknown": totals["size_unknown"], "TokenEstimate": totals["token_estimate"], "TotalSections": totals["total_sections"], "SkippedBySize": totals["skipped_by_size"]}
    ends = {"head": p.header(), "foot": p.footer(), "gap": F.lit("\n\n"), "line": F.lit("\n")}
    ends |= {k: F.lit(custom[name]({"Global": global_})) for k, name in (("head", "output_header"), ("foot", "output_footer")) if name in custom}
    known = rendered.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in ({"section": 0, "is_implicit": True} | totals).items()])
    known = known.select(*[c.alias(k) for k, c in ends.items()]).select("*", F.transform(F.array(*ends), tokenizer).alias("tokens")).first()
    tokens = dict(zip(ends, known["tokens"]))

    def piece(name: str):
        return known[name], tokens[name], {}

    if known["head"]:
        yield piece("head")
    open_row, wrote, compact = None, False, False
    for r in chain([first] if first else [], rows):
        row = r.asDict()
        if row["kind"] == "failure":
            yield "", 0, row
            continue
        if open_row is None or row["section"] != open_row["section"]:
            if open_row is not None and open_row["section_foot"]:
                yield open_row["section_foot"], open_row["foot_tokens"], {}
            if wrote and separators:
                yield piece("gap")
            open_row, wrote, compact = row, False, False
            if row["section_top"] and (row["kind"] != "section" or "section_header" in custom):
                yield row["section_top"], row["top_tokens"], {}
            if row["kind"] == "section":
                yield row["item"], row["tokens"], row
                wrote = True
                continue
        if wrote and separators:
            yield piece("line" if compact and row["is_compact"] else "gap")
        yield row["item"], row["tokens"], row
        wrote, compact = True, row["is_compact"]
    if open_row is not None and open_row["section_foot"]:
        yield open_row["section_foot"], open_row["foot_tokens"], {}
    if known["foot"]:
        yield piece("foot")


def stats_text(report: dict, color: bool = False, template: str = "") -> str:
    """The summary of a run; counts of skipped, binary and failed files only where there are any."""
    made = Template(template or DEFAULT_STATS, None, functions=STATS_FUNCTIONS, name="stats")({"Global": report, "ColorEnabled": color})
    notes = [f"{report[k]:,} {label}" for k, label in (("SkippedBySize", "skipped (size)"), ("BinaryFiles", "binary"), ("FailedFiles", "failed")) if report.get(k)]
    return made + (f"  {' · '.join(notes)}\n" if notes and not template else "")
