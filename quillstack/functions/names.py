"""What a path, an address or a first line says about an input: language, format, archive, document, repository."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of a file extension, of a whole file name, and of a script's interpreter.
LANGUAGE_BY_EXTENSION = {
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "cs": "csharp", "m": "objectivec", "mm": "objectivec", "swift": "swift", "val": "vala", "v": "v", "zig": "zig", "jl": "julia",
    "hs": "haskell", "lhs": "haskell", "ml": "ocaml", "mli": "ocaml", "pas": "pascal", "pp": "pascal", "adb": "ada", "ads": "ada",
    "cl": "lisp", "nim": "nim", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "groovy": "groovy",
    "gradle": "groovy", "clj": "clojure", "cljs": "clojure", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass",
    "less": "less", "vue": "vue", "svelte": "svelte", "wasm": "wasm", "py": "python", "pyw": "python", "rb": "ruby", "php": "php",
    "lua": "lua", "pl": "perl", "pm": "perl", "r": "r", "dart": "dart", "el": "lisp", "lisp": "lisp", "erl": "erlang",
    "ex": "elixir", "exs": "elixir", "sh": "bash", "bash": "bash", "zsh": "zsh", "ps1": "powershell", "bat": "batch",
    "cmd": "batch", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "xml": "xml", "svg": "xml", "ini": "ini",
    "conf": "ini", "md": "markdown", "markdown": "markdown", "csv": "csv", "tsv": "tsv", "sql": "sql", "graphql": "graphql",
    "gql": "graphql", "proto": "protobuf", "tf": "hcl", "tfvars": "hcl", "dockerfile": "dockerfile", "diff": "diff",
    "patch": "diff", "txt": "text", "log": "text",
}
LANGUAGE_BY_FILE = {
    "dockerfile": "dockerfile", "makefile": "makefile", "jenkinsfile": "groovy", "rakefile": "ruby", "gemfile": "ruby",
    "vagrantfile": "ruby", "procfile": "yaml", "go.mod": "gomod", "go.sum": "gosum", "package.json": "json",
    "tsconfig.json": "json", "composer.json": "json", "cargo.toml": "toml", ".gitignore": "gitignore",
    ".gitmodules": "gitconfig", ".bashrc": "bash", ".bash_profile": "bash", ".zshrc": "zsh", ".vimrc": "vim", ".npmrc": "ini",
    ".editorconfig": "ini", ".env": "bash",
}
LANGUAGE_BY_INTERPRETER = {
    "bash": "bash", "sh": "bash", "zsh": "zsh", "python": "python", "python2": "python", "python3": "python",
    "node": "javascript", "nodejs": "javascript", "ruby": "ruby", "perl": "perl", "php": "php", "lua": "lua", "make": "makefile",
}

# Formats by extension (name, kind, MIME type), suffixes of archives and documents, types of documents.
FORMATS = {
    "png": ("png", "image", "image/png"), "jpg": ("jpeg", "image", "image/jpeg"), "jpeg": ("jpeg", "image", "image/jpeg"),
    "gif": ("gif", "image", "image/gif"), "bmp": ("bmp", "image", "image/bmp"), "tif": ("tiff", "image", "image/tiff"),
    "tiff": ("tiff", "image", "image/tiff"), "ico": ("ico", "image", "image/x-icon"), "webp": ("webp", "image", "image/webp"),
    "avif": ("avif", "image", "image/avif"), "heic": ("heic", "image", "image/heic"), "svg": ("svg", "markup", "image/svg+xml"),
    "flac": ("flac", "audio", "audio/flac"), "wav": ("wav", "audio", "audio/wav"), "m4a": ("m4a", "audio", "audio/mp4"),
    "mp3": ("mp3", "audio", "audio/mpeg"), "webm": ("webm", "video", "video/webm"), "mkv": ("mkv", "video", "video/x-matroska"),
    "mov": ("mov", "video", "video/quicktime"), "mp4": ("mp4", "video", "video/mp4"), "m4v": ("mp4", "video", "video/mp4"),
}
ARCHIVE_SUFFIX = r"(?i)\.(zip|jar|war|ear|od[tsp]|tar|tgz|tbz2|txz|rar|7z|gz|bz2|xz|zst|br|lz4|sz|s2|lz)$"
DOCUMENT_SUFFIX = r"(?i)\.(pdf|docx|xlsx|pptx|html?|xhtml)$"
HTML_SUFFIX = r"(?i)\.(html?|xhtml)$"
DOCUMENT_TYPES = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
}


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case last extension without its dot; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


file_format = extension


def detect_language(path: Column, content: Column | None = None) -> Column:
    """By file name, by Dockerfile suffix, by extension, by the interpreter of a first line; else empty."""
    base = F.lower(base_name(path))
    found = F.coalesce(
        _look_up(LANGUAGE_BY_FILE, base),
        F.when(F.startswith(base, F.lit("dockerfile.")), "dockerfile"),
        _look_up(LANGUAGE_BY_EXTENSION, extension(path)),
    )
    if content is not None:
        first = F.regexp_extract(F.substring(content, 1, 1024), r"^#!\s*([^\n]*)", 1)
        words = F.split(F.trim(first), r"\s+")
        command = base_name(F.try_element_at(words, F.lit(1)))
        command = F.when((command == "env") & (F.size(words) > 1), base_name(F.try_element_at(words, F.lit(2)))).otherwise(command)
        found = F.coalesce(found, _look_up(LANGUAGE_BY_INTERPRETER, command))
    return F.coalesce(found, F.lit(""))


def language_of(path: str, text: str) -> str:
    """detect_language() of one file."""
    base = path.rpartition("/")[2].lower()
    extension_ = base.rpartition(".")[2] if "." in base else None
    found = LANGUAGE_BY_FILE.get(base) or ("dockerfile" if base.startswith("dockerfile.") else None) or LANGUAGE_BY_EXTENSION.get(extension_)
    if not found and text.startswith("#!"):
        words = text[2:1024].partition("\n")[0].split()
        command = words[0].rpartition("/")[2] if words else ""
        command = words[1].rpartition("/")[2] if command == "env" and len(words) > 1 else command
        found = LANGUAGE_BY_INTERPRETER.get(command)
    return found or ""


def format_by_extension(path: Column, part: int = 0) -> Column:
    """Name (0), kind (1) or MIME type (2) of the media format that the extension names; null for none."""
    return _look_up({k: v[part] for k, v in FORMATS.items()}, extension(path))


def mime_type(path: Column) -> Column:
    return F.coalesce(format_by_extension(path, 2), F.lit("application/octet-stream"))


def is_archive(path: Column) -> Column:
    return F.rlike(path, F.lit(ARCHIVE_SUFFIX))


def is_html(path: Column, media_type: Column | None = None) -> Column:
    by_name = F.rlike(path, F.lit(HTML_SUFFIX))
    return by_name if media_type is None else by_name | F.coalesce(_bare_type(media_type).isin("text/html", "application/xhtml+xml"), F.lit(False))


def is_document(path: Column, media_type: Column | None = None) -> Column:
    by_name = F.rlike(path, F.lit(DOCUMENT_SUFFIX))
    if media_type is None:
        return by_name
    return by_name | is_html(path, media_type) | F.coalesce(_bare_type(media_type).isin(*DOCUMENT_TYPES), F.lit(False))


def _bare_type(media_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(media_type, ";", 1)))


_HTTP = r"(?i)^https?://[^/?#]+"


def is_http_url(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(_HTTP))


def url_path(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def is_http_archive(text: Column) -> Column:
    return is_http_url(text) & is_archive(url_path(text))


def repo_archive_url(raw: Column) -> Column:
    """The archive to download for a repository address on a known host, else null."""
    text = F.trim(raw)
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.lower(F.regexp_extract(full, r"(?i)^https?://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "^/+|/+$", "")
    part = lambda pattern, k: F.regexp_extract(path, pattern, k)
    ref = lambda value: F.when(value == "", "HEAD").otherwise(value)
    plain = r"^([^/]+)/([^/]+?)(?:\.git)?(?:/{}/(.+))?$"
    hub, bit, berg = plain.format("tree"), plain.format("src"), plain.format("src/branch")
    lab = r"^([^/]+(?:/(?!-/|-$)[^/]+)*?)/((?!-$|-/)[^/]+?)(?:\.git)?(?:/-(?:/tree/(.+))?)?$"
    fits = lambda pattern: F.rlike(path, F.lit(pattern))
    github = F.concat(F.lit("https://github.com/"), part(hub, 1), F.lit("/"), part(hub, 2), F.lit("/archive/"))
    github = F.concat(github, F.when(part(hub, 3) == "", "HEAD").otherwise(F.concat(F.lit("refs/heads/"), part(hub, 3))), F.lit(".zip"))
    at = ref(part(lab, 3))
    gitlab = F.concat(F.lit("https://gitlab.com/"), part(lab, 1), F.lit("/"), part(lab, 2), F.lit("/-/archive/"), at, F.lit("/"), part(lab, 2), F.lit("-"), at, F.lit(".zip"))
    bitbucket = F.concat(F.lit("https://bitbucket.org/"), part(bit, 1), F.lit("/"), part(bit, 2), F.lit("/get/"), ref(part(bit, 3)), F.lit(".zip"))
    codeberg = F.concat(F.lit("https://codeberg.org/"), part(berg, 1), F.lit("/"), part(berg, 2), F.lit("/archive/"), ref(part(berg, 3)), F.lit(".zip"))
    return (
        F.when((host == "github.com") & fits(hub), github)
        .when((host == "gitlab.com") & fits(lab), gitlab)
        .when((host == "bitbucket.org") & fits(bit), bitbucket)
        .when((host == "codeberg.org") & fits(berg), codeberg)
    )


_PLAIN_REPOSITORY = r"^([^/]+)/([^/]+?)(?:\.git)?(?:/{}/(.+))?$"
_NESTED_REPOSITORY = r"^([^/]+(?:/(?!-/|-$)[^/]+)*?)/((?!-$|-/)[^/]+?)(?:\.git)?(?:/-(?:/tree/(.+))?)?$"
# How known hosts spell a repository's page and its archive (owner, name, ref).
REPOSITORY_HOSTS = {
    "github.com": (_PLAIN_REPOSITORY.format("tree"), "https://github.com/{0}/{1}/archive/{2}.zip"),
    "gitlab.com": (_NESTED_REPOSITORY, "https://gitlab.com/{0}/{1}/-/archive/{2}/{1}-{2}.zip"),
    "bitbucket.org": (_PLAIN_REPOSITORY.format("src"), "https://bitbucket.org/{0}/{1}/get/{2}.zip"),
    "codeberg.org": (_PLAIN_REPOSITORY.format("src/branch"), "https://codeberg.org/{0}/{1}/archive/{2}.zip"),
}


def repo_archive_of(raw: str) -> str | None:
    """repo_archive_url() of one address, on the driver."""
    text = raw.strip(" ")
    address = re.match(r"(?i)https?://([^/?#]+)([^?#]*)", text if "://" in text else f"https://{text}")
    if not address or (host := address[1].lower()) not in REPOSITORY_HOSTS:
        return None
    pattern, archive = REPOSITORY_HOSTS[host]
    if not (found := re.search(pattern, address[2].strip("/"))):
        return None
    ref = found[3] and (f"refs/heads/{found[3]}" if host == "github.com" else found[3])
    return archive.format(found[1], found[2], ref or "HEAD")
