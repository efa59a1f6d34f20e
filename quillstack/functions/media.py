"""Media formats told from their first bytes, and their metadata as text.

Parsers are generators of facts over the bytes: containers yield (path, payload) for the parts that matter, and a
description is put together from them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .names import FORMATS

HEAD = 1024
# Formats that share a container, and signatures as (offset, bytes).
FAMILY = {"webm": "matroska", "mkv": "matroska", "avif": "iso", "heic": "iso", "mov": "iso", "m4a": "iso", "mp4": "iso"}
SIGNATURES = (
    ("png", ((0, b"\x89PNG\r\n\x1a\n"),)), ("jpeg", ((0, b"\xff\xd8\xff"),)), ("gif", ((0, b"GIF87a"),)), ("gif", ((0, b"GIF89a"),)),
    ("tiff", ((0, b"II*\x00"),)), ("tiff", ((0, b"MM\x00*"),)), ("flac", ((0, b"fLaC"),)),
    ("wav", ((0, b"RIFF"), (8, b"WAVE"))), ("webp", ((0, b"RIFF"), (8, b"WEBP"))),
)
BRANDS = (("avif", ("avif", "avis")), ("heic", ("heic", "heix", "hevc", "hevx", "mif1", "msf1")), ("mov", ("qt",)), ("m4a", ("M4A",)))
# Names of codecs and colour models.
MP4_CODECS = {
    "avc1": "h264", "avc3": "h264", "hev1": "hevc", "hvc1": "hevc", "av01": "av1", "vp08": "vp8", "vp09": "vp9", "mp4v": "mpeg4",
    "s263": "h263", "jpeg": "mjpeg", "mp4a": "aac", "alac": "alac", "ac-3": "ac3", "ec-3": "eac3", "Opus": "opus", ".mp3": "mp3",
    "fLaC": "flac", "twos": "pcm", "sowt": "pcm", "lpcm": "pcm",
}
MKV_CODECS = {
    "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_AV1": "av1", "V_VP8": "vp8", "V_VP9": "vp9", "V_MPEG4/ISO/ASP": "mpeg4",
    "V_MPEG2": "mpeg2", "V_THEORA": "theora", "A_AAC": "aac", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_AC3": "ac3",
    "A_EAC3": "eac3", "A_TRUEHD": "truehd", "A_DTS": "dts", "A_MPEG/L3": "mp3", "A_MPEG/L2": "mp2", "A_ALAC": "alac",
}
WAV_CODECS = {3: "pcm_f32le", 6: "pcm_alaw", 7: "pcm_mulaw", 0x55: "mp3"}
PNG_MODELS = {0: "grayscale", 2: "rgb", 3: "indexed", 4: "grayscale+alpha", 6: "rgba"}
JPEG_MODELS = {1: "grayscale", 3: "ycbcr", 4: "cmyk"}
LOSSLESS = ("pcm", "alac", "flac")
# Bit rates (kbit/s) of MPEG audio by (is MPEG 1, layer), sample rates by version bits.
_LOW = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MP3_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): _LOW,
    (False, 3): _LOW,
}
MP3_SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass
class Media:
    """What a file's header says.  Streams are (codec, details...) texts in order; seconds and bit rate may be 0."""

    seconds: float = 0.0
    estimated: bool = False
    bitrate: int = 0
    video: list[str] = field(default_factory=list)
    audio: list[str] = field(default_factory=list)
    image: str | None = None

    def text(self, container: str, size: int) -> str:
        rate = self.bitrate or (int(size * 8 / self.seconds) if self.seconds > 0 and self.image is None else 0)
        lines = [f"Container: {container}"]
        if self.seconds > 0:
            ms = int(self.seconds * 1e9) // 1_000_000
            clock = f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
            lines.append(f"Duration: {clock}" + " (estimated)" * self.estimated)
        if rate > 0:
            lines.append("Bitrate: " + (f"{rate / 1e6:.1f} Mbps" if rate >= 1_000_000 else f"{rate // 1000} kbps" if rate >= 1000 else f"{rate} bps"))
        lines += [f"Video: {v}" for v in self.video] + [f"Audio: {a}" for a in self.audio] + ([f"Image: {self.image}"] if self.image else [])
        return "\n".join(lines) + "\n"


def _joined(*parts) -> str:
    return ", ".join(p for p in parts if p)


def _picture(width: int, height: int, model: str = "", bits: int = 0, frames: int = 0) -> str:
    return _joined(f"{width}x{height}" if width > 0 and height > 0 else "", model, f"{bits}-bit" if bits > 0 else "", f"{frames} frames" if frames > 1 else "")


def _film(codec: str, width: int, height: int, rate: float) -> str:
    return _joined(codec, f"{width}x{height}" if width > 0 and height > 0 else "", f"{rate:.2f} fps" if rate > 0 else "")


def _sound(codec: str, rate: int, channels: int, bits: int) -> str:
    layout = {0: "", 1: "mono", 2: "stereo"}.get(channels, f"{channels} channels")
    return _joined(codec, f"{rate} Hz" if rate > 0 else "", layout, f"{bits}-bit" if bits > 0 else "")


# Pictures


def png(d: bytes) -> Media | None:
    if not d.startswith(b"\x89PNG\r\n\x1a\n") or d[12:16] != b"IHDR":
        return None
    width, height, bits, model = struct.unpack_from(">IIBB", d, 16)
    return Media(image=_picture(width, height, PNG_MODELS.get(model, ""), bits))


def jpeg(d: bytes) -> Media | None:
    at = 2
    while d.startswith(b"\xff\xd8") and d[at] == 0xFF:
        marker, length = struct.unpack_from(">xBH", d, at)
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame's header
            bits, height, width, parts = struct.unpack_from(">BHHB", d, at + 4)
            return Media(image=_picture(width, height, JPEG_MODELS.get(parts, ""), bits))
        elif marker == 0xDA or length < 2:
            return None
        else:
            at += 2 + length
    return None


def gif(d: bytes) -> Media | None:
    if d[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    width, height, flags = struct.unpack_from("<HHB", d, 6)
    table = lambda f: 3 << ((f & 7) + 1) if f & 0x80 else 0
    at, frames, ticks = 13 + table(flags), 0, 0

    def skip(at):
        while at < len(d) and d[at]:
            at += 1 + d[at]
        return at + 1

    while at < len(d) and d[at] in (0x2C, 0x21):
        if d[at] == 0x2C:
            frames += 1
            if at + 10 > len(d):
                break
            at = skip(at + 11 + table(d[at + 9]))
        else:
            if d[at + 1 : at + 2] == b"\xf9" and at + 7 <= len(d):
                ticks += struct.unpack_from("<H", d, at + 4)[0]
            at = skip(at + 2)
    return Media(seconds=ticks / 100 if frames > 1 else 0.0, image=_picture(width, height, "indexed", (flags & 7) + 1, frames))


def _riff(d: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 12
    while at + 8 <= len(d):
        name, length = struct.unpack_from("<4sI", d, at)
        yield name, at + 8, length
        at += 8 + length + length % 2


def webp(d: bytes) -> Media | None:
    if d[:4] != b"RIFF" or d[8:12] != b"WEBP":
        return None
    shape, frames = None, 0
    for name, at, _ in _riff(d):
        if name == b"VP8 " and not shape:
            shape = (*(x & 0x3FFF for x in struct.unpack_from("<HH", d, at + 6)), "ycbcr")
        elif name == b"VP8L" and not shape:
            bits = struct.unpack_from("<I", d, at + 1)[0]
            shape = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "rgba")
        elif name == b"VP8X":
            shape = (int.from_bytes(d[at + 4 : at + 7], "little") + 1, int.from_bytes(d[at + 7 : at + 10], "little") + 1, "")
        frames += name == b"ANMF"
    return Media(image=_picture(*shape, frames=frames)) if shape else None


def bmp(d: bytes) -> Media | None:
    """Has no signature worth the name, so its header must make sense throughout."""
    if d[:2] != b"BM":
        return None
    kind = struct.unpack_from("<I", d, 14)[0]
    if kind not in (12, 16, 40, 52, 56, 64, 108, 124):
        return None
    width, height, planes, bits = struct.unpack_from("<HHHH" if kind == 12 else "<iiHH", d, 18)
    height = abs(height)
    plausible = 0 < width <= 1 << 16 and 0 < height <= 1 << 16 and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return Media(image=_picture(width, height, "rgb", bits)) if plausible else None


def ico(d: bytes) -> Media | None:
    """The largest picture of an icon; of equal ones the first."""
    reserved, kind, count = struct.unpack_from("<HHH", d, 0)
    if reserved or kind != 1 or not count:
        return None
    best = (0, 0, 0)
    for at in range(6, min(6 + 16 * count, len(d) - 15), 16):
        width, height, _, zero, planes, bits = struct.unpack_from("<BBBBHH", d, at)
        if zero or planes > 1 or bits not in (0, 1, 2, 4, 8, 16, 24, 32):
            return None
        width, height = width or 256, height or 256
        if width * height > best[0] * best[1]:
            best = (width, height, bits)
    return Media(image=_picture(best[0], best[1], f"{count} sizes" if count > 1 else "", best[2])) if best[0] else None


def tiff(d: bytes) -> Media | None:
    order = {b"II": "<", b"MM": ">"}.get(d[:2])
    if not order or struct.unpack_from(order + "H", d, 2)[0] != 42:
        return None
    at = struct.unpack_from(order + "I", d, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", d, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(d):
            break
        tag, kind, n, where = struct.unpack_from(order + "HHII", d, entry)
        form = order + ("H" if kind == 3 else "I")
        place = entry + 8 if n * struct.calcsize(form) <= 4 else where
        if tag in (256, 257, 258) and place + struct.calcsize(form) <= len(d):
            tags[tag] = struct.unpack_from(form, d, place)[0]
    width, height = tags.get(256, 0), tags.get(257, 0)
    return Media(image=_picture(width, height, "rgb", tags.get(258, 0))) if width or height else None


# Sound


def wav(d: bytes) -> Media | None:
    if d[:4] != b"RIFF" or d[8:12] != b"WAVE":
        return None
    sound, per_second, length = None, 0, 0
    for name, at, size in _riff(d):
        if name == b"fmt " and at + 16 <= len(d):
            kind, channels, rate, per_second, _, bits = struct.unpack_from("<HHIIHH", d, at)
            sound = _sound(WAV_CODECS.get(kind, f"pcm_s{bits}le"), rate, channels, bits)
        elif name == b"data":
            length = size
    return Media(seconds=length / per_second if per_second else 0.0, audio=[sound]) if sound else None


def flac(d: bytes) -> Media | None:
    if d[:4] != b"fLaC":
        return None
    packed = struct.unpack_from(">Q", d, 18)[0]
    rate, total = packed >> 44, packed & (1 << 36) - 1
    return Media(seconds=total / rate if rate else 0.0, audio=[_sound("flac", rate, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1)])


def mp3(d: bytes) -> Media | None:
    start = 0
    if d[:3] == b"ID3":
        start = 10
        for shift, byte in zip((21, 14, 7, 0), d[6:10]):
            start += (byte & 0x7F) << shift
    window = d[start : start + (64 << 10)]
    at = next((i for i in range(len(window) - 3) if window[i] == 0xFF and window[i + 1] >= 0xE0 and window[i + 1] >> 3 & 3 != 1 and window[i + 1] >> 1 & 3), None)
    if at is None:
        return None
    _, b, c, e = window[at : at + 4]
    version, layer, first = b >> 3 & 3, 4 - (b >> 1 & 3), (b >> 3 & 3) == 3
    if not 1 <= c >> 4 <= 14 or c >> 2 & 3 > 2 or (c >> 2 & 3) == 3:
        return None
    rate, bitrate = MP3_SAMPLE_RATES[version][c >> 2 & 3], MP3_RATES[first, layer][(c >> 4) - 1] * 1000
    channels = 1 if e >> 6 == 3 else 2
    media = Media(bitrate=bitrate, audio=[_sound(f"mp{layer}", rate, channels, 0)])
    frame = start + at
    side = (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
    tag, vbri = d[frame + 4 + side : frame + 16 + side], d[frame + 36 : frame + 54]
    frames = None
    if tag[:4] in (b"Xing", b"Info") and len(tag) == 12 and tag[7] & 1:
        frames = struct.unpack_from(">I", tag, 8)[0]
    elif vbri[:4] == b"VBRI" and len(vbri) == 18:
        frames = struct.unpack_from(">I", vbri, 14)[0]
    if frames is not None:
        media.seconds = frames * (384 if layer == 1 else 576 if layer == 3 and not first else 1152) / rate
    else:
        media.seconds, media.estimated = (len(d) - frame) * 8 / bitrate, True
    return media


# Films

_CONTAINERS = frozenset("moov trak mdia minf stbl iprp ipco".split())


def _boxes(d: bytes, at: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, stop) of the boxes of an ISO file, depth first, each container before what it holds."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", d, at)
        start = at + 8
        if size == 0:
            size = end - at
        elif size == 1:
            if start + 8 > len(d):
                return
            size, start = struct.unpack_from(">Q", d, start)[0], start + 8
        name = kind.decode("latin-1")
        if size < start - at or at + size > end:
            return
        here = (*path, name)
        yield here, start, at + size
        if name in _CONTAINERS:
            yield from _boxes(d, start, at + size, here)
        elif name == "meta":
            yield from _boxes(d, start + 4, at + size, here)
        at += size


def _clock(d: bytes, at: int) -> tuple[int, int]:
    """(units per second, units) of a movie's or track's header."""
    return struct.unpack_from(">II", d, at + 12) if d[at] == 0 else struct.unpack_from(">IQ", d, at + 20)


def _track(d: bytes, parts: dict[str, tuple[int, int]], media: Media) -> None:
    handler = d[parts["hdlr"][0] + 8 : parts["hdlr"][0] + 12] if "hdlr" in parts else b""
    codec, words = "", (0,) * 10
    if "stsd" in parts:
        at, stop = parts["stsd"]
        code = d[at + 12 : at + 16].decode("latin-1")
        codec = MP4_CODECS.get(code, code.strip())
        if at + 44 <= stop:
            words = struct.unpack_from(">10H", d, at + 24)
    if handler == b"vide":
        width, height = words[8], words[9]
        if not (width and height) and "tkhd" in parts:
            at = parts["tkhd"][0]
            width, height = (x >> 16 for x in struct.unpack_from(">II", d, at + (76 if d[at] == 0 else 88)))
        samples = 0
        if "stts" in parts:
            at, stop = parts["stts"]
            n = struct.unpack_from(">I", d, at + 4)[0]
            if at + 8 + 8 * n <= stop:
                samples = sum(struct.unpack_from(">" + "I4x" * n, d, at + 8))
        units, length = _clock(d, parts["mdhd"][0]) if "mdhd" in parts else (0, 0)
        media.video.append(_film(codec, width, height, samples * units / length if length else 0.0))
    elif handler == b"soun":
        media.audio.append(_sound(codec, words[8], words[4], words[5] if codec in LOSSLESS else 0))


def mp4(d: bytes) -> Media | None:
    if d[4:8] != b"ftyp":
        return None
    media, found, track = Media(), False, None
    for path, start, stop in _boxes(d, 0, len(d)):
        name = path[-1]
        found = found or path == ("moov",)
        if path == ("moov", "mvhd"):
            units, length = _clock(d, start)
            media.seconds = length / units if units else 0.0
        elif path == ("moov", "trak"):
            if track is not None:
                _track(d, track, media)
            track = {}
        elif path[:2] == ("moov", "trak"):
            track[name] = start, stop
        elif name == "ispe" and media.image is None:
            media.image, found = _picture(*struct.unpack_from(">II", d, start + 4)), True
    if track is not None:
        _track(d, track, media)
    return media if found else None


# Element numbers of Matroska.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION, TRACKS, TRACK = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
KIND, CODEC, VIDEO, WIDTH, HEIGHT, FRAME_NS, AUDIO, RATE, CHANNELS, BITS = 0x83, 0x86, 0xE0, 0xB0, 0xBA, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264


def _number(d: bytes, at: int, marked: bool) -> tuple[int, int]:
    """A number of varying width, and what follows it."""
    width = 9 - d[at].bit_length()
    value = int.from_bytes(d[at : at + width], "big")
    if width > 8 or at + width > len(d):
        raise IndexError
    return (value if marked else value & (1 << 7 * width) - 1), at + width


def _elements(d: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        kind, at = _number(d, at, True)
        start = _number(d, at, False)[1]
        size, unknown = _number(d, at, False)[0], (1 << 7 * (start - at)) - 1
        stop = len(d) if size == unknown or start + size > len(d) else start + size
        if stop > end:
            return
        yield kind, start, stop
        at = stop


def _real(raw: bytes) -> float:
    return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else 0.0


def mkv(d: bytes) -> Media | None:
    top = _elements(d, 0, len(d))
    if next(top)[0] != EBML:
        return None
    whole = lambda a, b: int.from_bytes(d[a:b], "big")
    for kind, a, b in top:
        if kind != SEGMENT:
            continue
        media, scale, ticks, seen = Media(), 1_000_000, 0.0, set()
        for part, a2, b2 in _elements(d, a, b):
            seen.add(part)
            if part == INFO:
                for k, x, y in _elements(d, a2, b2):
                    scale = whole(x, y) or scale if k == SCALE else scale
                    ticks = _real(d[x:y]) if k == DURATION else ticks
            elif part == TRACKS:
                for k, x, y in _elements(d, a2, b2):
                    if k == TRACK:
                        _mkv_track({**{e: d[p:q] for e, p, q in _elements(d, x, y)}, **{e: d[p:q] for c, m, n in _elements(d, x, y) if c in (VIDEO, AUDIO) for e, p, q in _elements(d, m, n)}}, media)
            if {INFO, TRACKS} <= seen:
                break
        media.seconds = ticks * scale / 1e9
        return media
    return None


def _mkv_track(e: dict[int, bytes], media: Media) -> None:
    whole = lambda k: int.from_bytes(e.get(k, b""), "big")
    raw = e.get(CODEC, b"").rstrip(b"\0").decode("latin-1")
    codec = MKV_CODECS.get(raw, raw.removeprefix("V_").removeprefix("A_").lower())
    if whole(KIND) == 1:
        media.video.append(_film(codec, whole(WIDTH), whole(HEIGHT), 1e9 / whole(FRAME_NS) if whole(FRAME_NS) else 0.0))
    elif whole(KIND) == 2:
        media.audio.append(_sound(codec, int(_real(e.get(RATE, b""))), whole(CHANNELS), whole(BITS) if codec in LOSSLESS else 0))


PARSERS = {"png": png, "jpeg": jpeg, "gif": gif, "webp": webp, "bmp": bmp, "ico": ico, "tiff": tiff, "wav": wav, "flac": flac, "mp3": mp3, "mkv": mkv, "webm": mkv} | dict.fromkeys(("mp4", "mov", "m4a", "avif", "heic"), mp4)


def parsed(name: str, data: bytes) -> Media | None:
    try:
        return PARSERS[name](data) if name in PARSERS else None
    except (struct.error, IndexError, StopIteration, ZeroDivisionError):
        return None


def sniff(head: bytes) -> str:
    """The format that the first bytes show; empty for none."""
    for name, marks in SIGNATURES:
        if all(head[at : at + len(mark)] == mark for at, mark in marks):
            return name
    if head[:4] == b"\x1a\x45\xdf\xa3":
        try:
            _, a, b = next(_elements(head, 0, len(head)))
            return "webm" if any(k == DOCTYPE and b"webm" in head[x:y] for k, x, y in _elements(head, a, b)) else "mkv"
        except (IndexError, StopIteration):
            return "mkv"
    if head[4:8] == b"ftyp":
        end = min(len(head), int.from_bytes(head[:4], "big"))
        brands = {head[8:12].decode("latin-1").strip(), *(head[at : at + 4].decode("latin-1").strip() for at in range(16, end - 3, 4))}
        return next((name for name, known in BRANDS if brands & set(known)), "mp4")
    return "mp3" if head[:3] == b"ID3" else ""


def looks_binary(head: bytes) -> bool:
    """A NUL or what isn't UTF-8 in the first 1024 bytes; a rune cut off at their end is forgiven."""
    head = head[:HEAD]
    if b"\0" in head:
        return True
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as error:
        return error.reason != "unexpected end of data"
    return False


def classify(path: str, head: bytes) -> str:
    """Format name of a file: text is none, a signature beats the extension outside its family, else the extension."""
    name = path.rpartition("/")[2]
    by_name = FORMATS.get(name.rpartition(".")[2].lower(), ("",))[0] if "." in name else ""
    if not head:
        return by_name
    if not looks_binary(head):
        return ""
    shown = sniff(head[:HEAD])
    return by_name if not shown or by_name in FAMILY and FAMILY.get(shown) == FAMILY[by_name] else shown


def metadata(container: str, data: bytes) -> str | None:
    """The description of a media file; None if neither name nor bytes say that it is one."""
    media = parsed(container, data)
    if media is None and (shown := sniff(data[:HEAD])) and shown != container and (media := parsed(shown, data)) is not None:
        container = shown
    if media is None:
        if not container:
            return None
        media = Media()
    return media.text(container, len(data))


def describe_media(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds media_format and media_text; null for files that aren't media."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for p, c in zip(batch.column(path).to_pylist(), batch.column(content)):
                data = c.as_py() or b""
                name = classify(p or "", bytes(data[:HEAD]))
                names.append(name or None)
                texts.append(metadata(name, bytes(data)) if name in PARSERS else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(texts, pa.string())], [*batch.schema.names, "media_format", "media_text"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("media_format", StringType()), StructField("media_text", StringType())]))
