"""Archives as tables of their entries: zip and tar in all their wrappings, and singly compressed files.

The format is told by content first and by name second.  Entries that escape by "..", aren't plain files or repeat a path are
left out; an entry that can't be read becomes a failure and the others stay.  Formats without a decoder here (rar, 7z)
give one failure for the archive.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.names import ARCHIVE_SUFFIX

try:
    import zstandard
except ImportError:
    zstandard = None

_SUFFIX = re.compile(ARCHIVE_SUFFIX.removeprefix("(?i)"), re.I)
# First bytes of the formats.
MAGIC = ((b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zst"), (b"Rar!", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"\x04\x22\x4d\x18", "lz4"), (b"\xff\x06\x00\x00sNaPpY", "sz"), (b"LZIP", "lz"))
# Formats of one compressed stream, and other names for them.
STREAMS = ("gz", "bz2", "xz", "zst", "br", "lz4", "sz", "lz")
OTHER_NAMES = {"s2": "sz"}
ENTRY = "path string, archive string, entry string, size long, mod_time timestamp, content binary, failure string"


@dataclass(frozen=True)
class Member:
    """One entry: its key (clean path), name in the archive, size (limit + 1 if it was left unread), time and bytes."""

    key: str
    entry: str
    size: int
    mod_time: datetime | None = None
    content: bytes | None = None
    failure: str | None = None


def is_archive_name(path: str) -> bool:
    return _SUFFIX.search(path) is not None


def clean_entry(name: str) -> str:
    """Entry path without "./" and leading "/"; empty for the archive's own root."""
    path = posixpath.normpath(name.replace("\\", "/")).lstrip("/") if name else ""
    return "" if path == "." else path


def identify(data: bytes, name: str) -> str:
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    if data[257:262] == b"ustar":
        return "tar"
    try:  # tars of before ustar have no mark but a checksum
        if len(data) >= 512:
            tarfile.TarInfo.frombuf(data[:512], "utf-8", "surrogateescape")
            return "tar"
    except tarfile.TarError:
        pass
    suffix = name.lower().rpartition(".")[2] if is_archive_name(name) else ""
    return OTHER_NAMES.get(suffix, suffix)


def snappy_stream(data: bytes) -> Iterator[bytes]:
    """The chunks of the snappy framing format; checksums aren't compared."""
    codec, at = pa.Codec("snappy"), 0
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise EOFError("unexpected end of stream")
        at += 4 + size
        if kind == 1:
            yield body[4:]
        elif kind == 0:
            length = shift = 0
            for byte in body[4:9]:
                length |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            if length > 1 << 16:
                raise ValueError("chunk too large")
            yield codec.decompress(body[4:], length, asbytes=True)
        elif 2 <= kind < 0x80:
            raise ValueError("unknown chunk")


def lzip_stream(data: bytes) -> Iterator[bytes]:
    """The members of an lzip file, each checked against its checksum."""
    while data:
        if data[:4] != b"LZIP" or len(data) < 26:
            raise ValueError("no lzip member")
        size = 1 << (data[5] & 31)
        filters = [{"id": lzma.FILTER_LZMA1, "dict_size": size - size // 16 * (data[5] >> 5), "lc": 3, "lp": 0, "pb": 2}]
        decoder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
        member = decoder.decompress(data[6:])
        rest = decoder.unused_data
        if not decoder.eof or len(rest) < 20:
            raise EOFError("unexpected end of stream")
        if zlib.crc32(member) != int.from_bytes(rest[:4], "little"):
            raise ValueError("wrong checksum")
        yield member
        data = rest[20:]


class _Chunks(io.RawIOBase):
    """A readable stream of an iterator of bytes; only what is asked for is decoded."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            if (chunk := next(self.chunks, None)) is None:
                return 0
            self.held = chunk
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def opened(kind: str, data: bytes):
    raw = io.BytesIO(data)
    if kind == "gz":
        return gzip.GzipFile(fileobj=raw)
    if kind == "bz2":
        return bz2.BZ2File(raw)
    if kind == "xz":
        return lzma.LZMAFile(raw)
    if kind == "zst" and zstandard:
        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    if kind in ("lz4", "br"):
        return pa.CompressedInputStream(raw, "brotli" if kind == "br" else kind)
    if kind in ("sz", "lz"):
        return io.BufferedReader(_Chunks((snappy_stream if kind == "sz" else lzip_stream)(data)))
    raise ValueError("no readable format")


def bounded(stream, claimed: int, limit: int) -> tuple[bytes | None, int]:
    """Content and size; over a positive limit no content and limit + 1.  A claimed size is never trusted."""
    data = stream.read(limit + 1) if limit > 0 else stream.read()
    if limit > 0 and len(data) > limit:
        return None, limit + 1
    if 0 <= len(data) < claimed:
        raise EOFError("unexpected end of entry")
    return data, len(data)


def _members(kind: str, data: bytes, name: str) -> Iterator[tuple[str, bool, bool, int, datetime | None, Callable]]:
    """(name, is directory, is plain file, claimed size, time, opener) of each entry."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                mode = info.external_attr >> 16
                plain = not info.is_dir() and (mode & 0o170000) in (0, 0o100000)
                yield info.filename, info.is_dir(), plain, info.file_size, datetime(*info.date_time, tzinfo=UTC), lambda info=info: z.open(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(data) if kind == "tar" else opened(kind, data), mode="r|") as t:
            for info in t:
                yield info.name, info.isdir(), info.isreg(), info.size, datetime.fromtimestamp(info.mtime, UTC), lambda info=info: t.extractfile(info)


def is_tar(kind: str, data: bytes) -> bool:
    try:
        head = opened(kind, data).read(512)
    except (OSError, EOFError, ValueError, lzma.LZMAError):
        return False
    return identify(head, "") == "tar"


def expand(data: bytes, name: str, keep: Callable[[str, bool], bool] = lambda key, is_dir: True, limit: int = 0) -> list[Member]:
    """The entries that `keep` lets through, in walk order, and failures; of one path the first entry counts."""
    kind = identify(data, name)
    found: dict[str, Member] = {}
    failures: list[Member] = []
    try:
        if kind in STREAMS and not is_tar(kind, data):
            base = posixpath.basename(name)
            key = posixpath.splitext(base)[0] or base
            if keep(key, False):
                content, size = bounded(opened(kind, data), -1, limit)
                found[key] = Member(key, key, size, None, content)
        elif kind in ("zip", "tar", *STREAMS):
            for raw, is_dir, plain, claimed, time, source in _members(kind, data, name):
                key = clean_entry(raw)
                if not key or key == ".." or key.startswith("../") or is_dir or not plain or key in found or not keep(key, False):
                    continue
                if limit > 0 and claimed > limit:
                    found[key] = Member(key, raw, claimed, time)
                    continue
                try:
                    content, size = bounded(source(), claimed, limit)
                    found[key] = Member(key, raw, size, time, content)
                except (OSError, EOFError, RuntimeError, ValueError, NotImplementedError, zipfile.BadZipFile, tarfile.TarError) as error:
                    failures.append(Member(key, raw, -1, failure=f"archive entry: {error}"))
        else:
            raise ValueError("no readable format")
    except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError) as error:
        if not failures:
            failures.append(Member("", "", -1, failure=f"archive: {error}"))
    except Exception as error:
        if zstandard is None or not isinstance(error, zstandard.ZstdError):
            raise
        failures.append(Member("", "", -1, failure=f"archive: {error}"))
    return sorted(found.values(), key=lambda m: m.key.encode("utf-8", "surrogateescape").split(b"/")) + failures


class LastArchive:
    """Entries of archives by path, one archive at a time: neighbours in a task come from the same archive."""

    def __init__(self):
        self.path, self.members = None, {}

    def content(self, path: str, entry: str, limit: int = 0) -> tuple[bytes | None, str | None]:
        """(content, failure) of an entry as it is called inside the archive."""
        if self.path != (path, limit):
            self.members = {}
            try:
                with open(path, "rb") as f:
                    self.members = {m.entry: m for m in expand(f.read(), path, limit=limit)}
            except OSError as error:
                return None, f"read: {error.strerror or error}"
            self.path = (path, limit)
        found = self.members.get(entry)
        if found is None:
            return None, "archive entry: it is gone"
        return (found.content, None) if found.content is not None else (None, found.failure or "archive entry: it is too large")


def wrapper(names: list[str]) -> str:
    """The one directory that every entry of a repository's archive is below, or nothing."""
    top, slash, _ = names[0].partition("/") if names else ("", "", "")
    return top if slash and all(n == top + "/" or n.startswith(top + "/") for n in names) else ""


def expand_repository(data: bytes, keep: Callable[[str, bool], bool] = lambda key, is_dir: True, limit: int = 0) -> list[Member]:
    """As expand(), of a repository host's zip: the directory around it is left out of keys."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            top = wrapper([i.filename for i in z.infolist()])
    except zipfile.BadZipFile as error:
        return [Member("", "", -1, failure=f"archive: {error}")]
    cut = len(top) + 1 if top else 0
    members = expand(data, "repository.zip", lambda key, is_dir: keep(key[cut:], is_dir), limit)
    return [Member(m.key[cut:], m.entry, m.size, m.mod_time, m.content, m.failure) for m in members]


def expand_archives(files: DataFrame, keep: Callable[[str, bool], bool] = lambda key, is_dir: True, limit: int = 0) -> DataFrame:
    """Rows of `files` (path, abs_path, content) that are archives, as rows of their entries (ENTRY)."""

    def run(batches):
        names = [c.split()[0] for c in ENTRY.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                for m in expand(row["content"] or b"", row["path"], lambda key, is_dir: keep(f"{row['path']}/{key}", is_dir), limit):
                    shown = f"{row['path']}/{m.key}" if m.key else row["path"]
                    values = (shown, row["abs_path"], m.entry, m.size, m.mod_time, m.content, m.failure)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return files.select("path", "abs_path", "content").mapInArrow(run, ENTRY)
