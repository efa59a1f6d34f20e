import io
import struct
import wave
import zlib

import pytest

from quillstack.functions import media


def png(width=32, height=16):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def gif(frames):
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 3, 0x80, 0, 0) + b"\0" * 6
    for _ in range(frames):
        out += b"\x21\xf9\x04\x00" + struct.pack("<H", 10) + b"\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 3, 0) + b"\x02\x01\x00\x00"
    return out + b"\x3b"


def tone():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\1\2" * 8000)
    return out.getvalue()


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def film():
    header = lambda rate, n: struct.pack(">IIIII", 0, 0, 0, rate, n)
    entry = struct.pack(">I4s6xH", 86, b"avc1", 1) + b"\0" * 16 + struct.pack(">HH", 64, 48) + b"\0" * 50
    video = box("trak", box("tkhd", b"\0" * 84), box("mdia", box("mdhd", header(1000, 2000)), box("hdlr", b"\0" * 8, b"vide", b"\0" * 12), box("minf", box("stbl", box("stsd", struct.pack(">II", 0, 1), entry), box("stts", struct.pack(">IIII", 0, 1, 50, 40))))))
    sound = struct.pack(">I4s6xH", 36, b"mp4a", 1) + b"\0" * 8 + struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16)
    audio = box("trak", box("mdia", box("hdlr", b"\0" * 8, b"soun", b"\0" * 12), box("minf", box("stbl", box("stsd", struct.pack(">II", 0, 1), sound)))))
    return box("ftyp", b"isom\0\0\0\0isom") + box("moov", box("mvhd", header(600, 1200)), video, audio)


def element(kind, *parts):
    body = b"".join(parts)
    raw = kind.to_bytes((kind.bit_length() + 7) // 8, "big")
    return raw + (0x4000 | len(body)).to_bytes(2, "big") + body


def matroska(doctype):
    u = lambda v: v.to_bytes(4, "big")
    video = element(media.TRACK, element(media.KIND, b"\1"), element(media.CODEC, b"V_VP9"), element(media.VIDEO, element(media.WIDTH, u(320)), element(media.HEIGHT, u(240))), element(media.FRAME_NS, u(40_000_000)))
    audio = element(media.TRACK, element(media.KIND, b"\2"), element(media.CODEC, b"A_OPUS"), element(media.AUDIO, element(media.RATE, struct.pack(">d", 48000)), element(media.CHANNELS, b"\2"), element(media.BITS, b"\x20")))
    return element(media.EBML, element(media.DOCTYPE, doctype)) + element(media.SEGMENT, element(media.INFO, element(media.DURATION, struct.pack(">f", 1500.0))), element(media.TRACKS, video, audio))


MP3 = b"ID3\3\0\0\0\0\0\x0a" + b"\0" * 10 + b"\xff\xfb\x90\xc0" + b"\0" * 413
CASES = [
    ("a.png", png(), "png", "Container: png\nImage: 32x16, rgb, 8-bit\n"),
    ("a.gif", gif(1), "gif", "Container: gif\nImage: 4x3, indexed, 1-bit\n"),
    ("a", gif(10), "gif", "Container: gif\nDuration: 00:00:01.000\nImage: 4x3, indexed, 1-bit, 10 frames\n"),
    ("a.jpg", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 9, "jpeg", "Container: jpeg\nImage: 32x16, ycbcr, 8-bit\n"),
    ("a.webp", b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + b"\x1f\0\0\x0f\0\0", "webp", "Container: webp\nImage: 32x16\n"),
    ("a.bmp", b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 5, -7, 1, 24) + b"\0" * 30, "bmp", "Container: bmp\nImage: 5x7, rgb, 24-bit\n"),
    ("a.ico", struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 16, 16, 0, 0, 1, 8, 0, 0) + struct.pack("<BBBBHHII", 0, 0, 0, 0, 1, 32, 0, 0), "ico", "Container: ico\nImage: 256x256, 2 sizes, 32-bit\n"),
    ("a.tif", b"II*\0" + struct.pack("<IH", 8, 3) + struct.pack("<HHIHH", 256, 3, 1, 9, 0) + struct.pack("<HHII", 257, 4, 1, 6) + struct.pack("<HHII", 258, 3, 3, 0), "tiff", None),
    ("a.wav", tone(), "wav", "Container: wav\nDuration: 00:00:01.000\nBitrate: 128 kbps\nAudio: pcm_s16le, 8000 Hz, mono, 16-bit\n"),
    ("a.flac", b"fLaC" + b"\0" * 14 + struct.pack(">Q", 44100 << 44 | 1 << 41 | 15 << 36 | 88200) + b"\0" * 16, "flac", "Container: flac\nDuration: 00:00:02.000\nBitrate: 168 bps\nAudio: flac, 44100 Hz, stereo, 16-bit\n"),
    ("a.mp3", MP3, "mp3", "Container: mp3\nDuration: 00:00:00.026 (estimated)\nBitrate: 128 kbps\nAudio: mp3, 44100 Hz, mono\n"),
    ("a.mov", film(), "mov", None),
    ("a.bin", film(), "mp4", None),
    ("a.webm", matroska(b"webm"), "webm", None),
    ("odd.png", matroska(b"matroska"), "mkv", None),
]


@pytest.mark.parametrize("path, data, name, text", CASES)
def test_formats(path, data, name, text):
    assert media.classify(path, data[: media.HEAD]) == name
    got = media.metadata(name, data)
    if text:
        assert got == text
    assert media.metadata("", data) in (got, None) or name in ("mov", "bmp", "ico")


def test_films():
    got = media.metadata("mp4", film()).split("\n")
    assert got[1] == "Duration: 00:00:02.000" and got[3:] == ["Video: h264, 64x48, 25.00 fps", "Audio: aac, 44100 Hz, stereo", ""]
    got = media.metadata("webm", matroska(b"webm")).split("\n")
    assert got[1] == "Duration: 00:00:01.500" and got[3:] == ["Video: vp9, 320x240, 25.00 fps", "Audio: opus, 48000 Hz, stereo", ""]
    still = box("ftyp", b"avif\0\0\0\0") + box("meta", b"\0" * 4, box("iprp", box("ipco", box("ispe", struct.pack(">III", 0, 40, 30)))))
    assert media.classify("x", still) == "avif" and media.metadata("avif", still) == "Container: avif\nImage: 40x30\n"


def test_lookalikes_and_broken_files():
    assert media.classify("notes.bmp", b"BM is how this text starts") == ""
    assert media.classify("x.svg", b"<svg/>") == "" and media.classify("x.png", b"") == "png"
    assert media.metadata("bmp", b"BM" + b"\xff" * 60) == "Container: bmp\n"
    assert media.metadata("", b"\0\1\2") is None
    for _, data, name, _ in CASES:
        for cut in range(0, min(len(data), 200), 3):
            assert media.metadata(name, data[:cut]).startswith("Container: ")


def test_rows(spark):
    rows = [("a.png", bytearray(png())), ("b.txt", bytearray(b"text")), ("c", None)]
    got = {x["path"]: (x["media_format"], x["media_text"]) for x in media.describe_media(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.png": ("png", "Container: png\nImage: 32x16, rgb, 8-bit\n"), "b.txt": (None, None), "c": (None, None)}
