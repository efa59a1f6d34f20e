"""Text functions as Column expressions; all run JVM-side."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_ABOVE, SAMPLE_HEAD, SAMPLE_TAIL = 262144, 131072, 65536
_WORD, _BLANK = "[A-Za-z0-9_]+", r"[ \t\r\x0B\f]+"


def _scan(latin: Column) -> Column:
    """Tokens of bytes given as ISO-8859-1 text, in integer hundredths.

    Only the first replacement reads the whole text: with each word as one "w", the rest is a third as long.
    """
    total = F.length(latin).cast("long")
    short = F.regexp_replace(latin, _WORD, "w")
    length = F.length(short).cast("long")
    without = lambda pattern: length - F.length(F.regexp_replace(short, pattern, "")).cast("long")
    single = lambda c: length - F.length(F.replace(short, F.lit(c), F.lit(""))).cast("long")
    runs, breaks = single("w"), single("\n")
    words = total - length + runs
    blanks, high = without(_BLANK), without("[\\x80-\\xFF]+")
    symbols = length - runs - blanks - high - breaks
    extra = F.floor(F.greatest(F.lit(0), words - 4 * runs) * 100 / 4).cast("long")
    hundredths = 100 * runs + extra + 55 * symbols + 30 * F.regexp_count(short, F.lit(_BLANK)).cast("long") + 100 * breaks + 50 * high
    return F.floor(hundredths / 100).cast("long")


def token_estimate(content: Column, size: Column | None = None) -> Column:
    """Estimated tokens of a text or binary column; long content is judged by its head and tail.

    The scans stand outside conditions, where the code generator shares their common parts.
    """
    data = F.coalesce(content.cast("binary"), F.lit(b""))
    n = F.octet_length(data).cast("long")
    latin, long_ = F.decode(data, "ISO-8859-1"), n > SAMPLE_ABOVE
    head = F.substring(latin, F.lit(1), F.when(long_, SAMPLE_HEAD).otherwise(SAMPLE_ABOVE))
    tail = F.substring(latin, F.lit(-SAMPLE_TAIL), F.when(long_, SAMPLE_TAIL).otherwise(0))
    scale, whole = F.when(long_, n).otherwise(1), F.when(long_, SAMPLE_HEAD + SAMPLE_TAIL).otherwise(1)
    seen = F.floor((_scan(head) + _scan(tail)) * scale / whole).cast("long")
    return seen + F.when(n == 0, size_tokens(size if size is not None else F.lit(0))).otherwise(0)


def size_tokens(size: Column) -> Column:
    """Tokens guessed from a size alone; truncates toward zero, so an unknown size (-1) gives 0."""
    return (F.signum(size) * F.floor(F.abs(size) / 4)).cast("long")


def count_lines(text: Column) -> Column:
    """Lines of a text; a last line without a line break counts."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def end_newline(text: Column) -> Column:
    return F.when((text != "") & ~F.endswith(text, F.lit("\n")), F.concat(text, F.lit("\n"))).otherwise(text)


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def commafy(n: Column) -> Column:
    return F.format_number(n, 0)


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def humanize(size: Column) -> Column:
    """1000-based size with one decimal, as printf's %.1f of the binary quotient gives it."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB", "TB", "TB"), 1):
        tenths = _tenths(size.cast("double") / F.lit(float(1000**power)))
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= 1000**power, text).otherwise(out)
    return out


def _tenths(value: Column) -> Column:
    """Tenths of a double >= 0, rounded by its exact binary value, ties to even."""
    whole = F.floor(value)
    part = value - whole  # exact
    low = F.least(F.lit(9), F.floor(part * 10))
    middle = (2 * low + 1).cast("double") / F.lit(20.0)
    # Where part is the double next to the middle, the middle's own rounding error decides; .25 and .75 are exact ties.
    at_middle = F.element_at(F.array(*[F.lit(_at_middle(k)) for k in range(10)]), (low + 1).cast("int"))
    up = F.when(part > middle, 1).when(part < middle, 0).otherwise(at_middle)
    return (whole * 10 + low + up).cast("long")


def _at_middle(k: int) -> int:
    gap = Fraction((2 * k + 1) / 20) - Fraction(2 * k + 1, 20)
    return int(gap > 0) if gap else k % 2


#: Layouts are written by the reference time Mon Jan 2 15:04:05 2006; longest parts first.
_LAYOUT = [
    ("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "EEE"), ("01", "MM"), ("02", "dd"), ("15", "HH"),
    ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("-0700", "xx"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("MST", "zzz"),
    ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]


def date_pattern(layout: str) -> str:
    """A reference-time layout as a Spark date pattern."""
    out, plain, i = [], "", 0
    parts = sorted(_LAYOUT, key=lambda x: -len(x[0]))
    while i < len(layout):
        hit = next(((a, b) for a, b in parts if layout.startswith(a, i)), None)
        if hit:
            if plain:
                out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in plain) else plain)
                plain = ""
            out.append(hit[1])
            i += len(hit[0])
        else:
            plain += layout[i]
            i += 1
    if plain:
        out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in plain) else plain)
    return "".join(out)


def date(layout: str, ts: Column) -> Column:
    return F.date_format(ts, date_pattern(layout))


def data_uri(mime: Column, data: Column) -> Column:
    """A data: URI; line breaks that Spark may put into base64 are taken out."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


def is_binary(data: Column) -> Column:
    """Whether the first 1024 bytes hold a NUL or aren't UTF-8; a rune cut off at the end is forgiven."""
    head = F.substring(data, 1, 1024)
    latin = F.decode(head, "ISO-8859-1")
    # An unfinished rune at the end: lead byte with too few continuation bytes.
    whole = F.regexp_replace(latin, "(?s)(?:[\\xC2-\\xDF]|[\\xE0-\\xEF][\\x80-\\xBF]?|[\\xF0-\\xF4][\\x80-\\xBF]{0,2})$", "")
    return F.coalesce((F.octet_length(head) > 0) & (F.contains(latin, F.lit("\0")) | ~F.is_valid_utf8(F.encode(whole, "ISO-8859-1").cast("string"))), F.lit(False))


#: Units by how a size is written; the longest suffix counts.
UNITS = {"gb": 10**9, "mb": 10**6, "kb": 1000, "g": 10**9, "m": 10**6, "k": 1000, "b": 1}


def parse_size(text: Column) -> Column:
    """Bytes of a size like 512k or 2MB; null for what isn't one (zero, negative, fraction, blank, overflow)."""
    low = F.lower(F.trim(text))
    digits = F.regexp_extract(low, r"^\+?([0-9]{1,19})(?:gb|mb|kb|g|m|k|b)?$", 1)
    n = F.when(digits != "", digits).cast("decimal(20,0)")
    unit = F.regexp_extract(low, r"(gb|mb|kb|g|m|k|b)$", 1)
    scale = F.lit(1).cast("long")
    for name, value in UNITS.items():
        scale = F.when(unit == name, F.lit(value)).otherwise(scale)
    limit = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    for value in {*UNITS.values()} - {1}:
        limit = F.when(scale == value, F.lit((1 << 62) // value).cast("decimal(20,0)")).otherwise(limit)
    return F.when((n > 0) & (n <= limit), (n * scale.cast("decimal(10,0)")).cast("long"))
