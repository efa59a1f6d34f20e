"""Web inputs: addresses as files, archives by address, and repositories read as checkouts.

Fetching is a function (url -> body, media type) that callers may replace; the default uses urllib with a timeout.
"""

from __future__ import annotations

import posixpath
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable
from io import BytesIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..operators.globs import parse_ignore
from .archives import Member, expand_repository, wrapper
from .walk import GIT_FILE, IGNORE_FILES, Options, last_match

TIMEOUT = 30
Fetcher = Callable[[str], tuple[bytes, str]]


def fetch(url: str) -> tuple[bytes, str]:
    """Body and media type; any status but 2xx is an error."""
    with urllib.request.urlopen(url, timeout=TIMEOUT) as response:
        if not 200 <= response.status < 300:
            raise OSError(f"{response.status} {response.reason}")
        return response.read(), response.headers.get("Content-Type", "")


def is_http_url(text: str) -> bool:
    try:
        parts = urlsplit(text.strip())
    except ValueError:
        return False
    return parts.scheme.lower() in ("http", "https") and bool(parts.netloc)


def fetch_urls(urls: DataFrame, fetcher: Fetcher = fetch, column: str = "url") -> DataFrame:
    """Adds content, media_type and failure to a table of addresses; fetched by the executors, one at a time per task."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body, kind, failure = None, None, None
                try:
                    body, kind = fetcher(row[column])
                except (OSError, urllib.error.URLError, ValueError) as error:
                    failure = f"url: {error}"
                one = pa.RecordBatch.from_pylist([row], schema=batch.schema)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([body], pa.binary()), pa.array([kind], pa.string()), pa.array([failure], pa.string())], [*batch.schema.names, "content", "media_type", "failure"])

    added = [StructField("content", BinaryType()), StructField("media_type", StringType()), StructField("failure", StringType())]
    return urls.mapInArrow(run, StructType([*urls.schema.fields, *added]))


class Checkout:
    """Judges the files of a repository's archive as a walk of its checkout would: ignore files in it apply."""

    def __init__(self, data: bytes, options: Options):
        self.options, self.files, self.known = options, {}, {}
        with zipfile.ZipFile(BytesIO(data)) as z:
            entries = z.namelist()
            cut = len(wrapper(entries)) + 1 if wrapper(entries) else 0
            for name in entries:
                if posixpath.basename(name) in (GIT_FILE, *IGNORE_FILES) and not options.no_ignore:
                    self.files[name[cut:]] = z.read(name).decode("utf-8", "surrogateescape")

    def rules(self, folder: str) -> list:
        if (found := self.known.get(folder)) is None:
            if folder:
                above = list(self.rules(posixpath.dirname(folder)))
            else:
                above = [] if self.options.no_ignore else parse_ignore(self.options.ignore_rules) + parse_ignore(self.options.git_excludes)
            for name in (GIT_FILE, *IGNORE_FILES):
                above += parse_ignore(self.files.get(posixpath.join(folder, name), ""), folder)
            found = self.known[folder] = above
        return found

    def skips(self, path: str, is_dir: bool) -> bool:
        kept = last_match(self.options.globs, path, is_dir)
        if kept is None and self.options.whitelist and not is_dir:
            kept = False
        if kept is None:
            kept = last_match(self.rules(posixpath.dirname(path)), path, is_dir)
            if kept is None and not self.options.hidden and posixpath.basename(path).startswith("."):
                kept = False
        return kept is False

    def keep(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        return not any(self.skips("/".join(parts[:k]), True) for k in range(1, len(parts))) and not self.skips(path, is_dir)


def repository_files(repository: str, archive_url: str, options: Options = Options(), limit: int = 0, fetcher: Fetcher = fetch) -> list[Member]:
    """Entries of a repository's archive, keys as shown below the repository's address."""
    try:
        data, _ = fetcher(archive_url)
    except (OSError, ValueError) as error:
        return [Member("", "", -1, failure=f"url: download {archive_url}: {error}")]
    try:
        judge = Checkout(data, options)
    except zipfile.BadZipFile as error:
        return [Member("", "", -1, failure=f"archive: {error}")]
    base = repository.rstrip("/")
    found = expand_repository(data, judge.keep, limit)
    return [Member(f"{base}/{m.key}" if m.key else base, m.entry, m.size, m.mod_time, m.content, m.failure) for m in found]
