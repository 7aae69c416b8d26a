"""Titles and sample rates out of audio files: RIFF INFO lists, ID3v2 tags, and the headers of MPEG frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.sources.files import stem

# Names of the fields in RIFF INFO lists and in ID3v2.2 and later tags; encodings of ID3v2 texts.
INFO = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"ITRK": "track", b"IPRT": "track"}
ID3 = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TRCK": "track", b"TT2": "title", b"TP1": "artist", b"TAL": "album", b"TRK": "track"}
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
# Sample rates of MPEG 1, and bit rates in kbit/s by (is MPEG 1, layer).
RATES = (44100, 48000, 32000)
BITS = {
    (True, 1): tuple(32 * k for k in range(1, 15)), (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Frames in a row that agree before a rate is believed.
AGREEING = 3


def synchsafe(data: bytes) -> int:
    """A number in the low seven bits of each byte."""
    out = 0
    for b in data:
        out = out << 7 | b & 0x7F
    return out


def riff_chunks(data: bytes, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of chunks, which begin at even places; one that is cut off ends with the data."""
    while at + 8 <= stop:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(stop, at + 8 + size)
        at += 8 + size + size % 2


def riff_fields(data: bytes) -> dict:
    out = {}
    for name, start, end in riff_chunks(data, 12, len(data)):
        if name == b"fmt " and end - start >= 8:
            out["rate"] = struct.unpack_from("<I", data, start + 4)[0]
        elif name == b"LIST" and data[start : start + 4] == b"INFO":
            for key, a, b in riff_chunks(data, start + 4, end):
                if key in INFO:
                    raw = data[a:b].split(b"\0")[0]
                    try:
                        out.setdefault(INFO[key], raw.decode())
                    except UnicodeDecodeError:
                        out.setdefault(INFO[key], raw.decode("latin-1"))
    return out


def id3_fields(data: bytes) -> tuple[dict, int]:
    """Fields of a tag at the start of data, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return {}, 0
    version, flags, end = data[3], data[5], 10 + synchsafe(data[6:10])
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, out = 0, {}
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head, name_size = (6, 3) if version == 2 else (10, 4)
    while at + head <= len(body) and body[at]:
        name, raw = body[at : at + name_size], body[at + name_size : at + 2 * name_size]
        size = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + size]
        if version == 4 and body[at + 9] & 0x02:
            value = value.replace(b"\xff\0", b"\xff")
        if version == 4 and body[at + 9] & 0x01:
            value = value[4:]  # behind its length
        if name in ID3 and value and value[0] in ENCODINGS:
            out.setdefault(ID3[name], value[1:].decode(ENCODINGS[value[0]], errors="ignore").split("\0")[0])
        at += head + size
    return out, end


def mpeg_frame(data: bytes, at: int) -> tuple[int, int, tuple] | None:
    """(rate, bytes, kind) of the frame whose header is at a place; None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    bits, rate, padded = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    hertz = RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    bit_rate = 1000 * BITS[version == 3, layer][bits - 1]
    if layer == 1:
        return hertz, (12 * bit_rate // hertz + padded) * 4, (version, layer, rate)
    return hertz, (144 if version == 3 or layer == 2 else 72) * bit_rate // hertz + padded, (version, layer, rate)


def mpeg_rate(data: bytes, at: int = 0) -> int | None:
    """The sample rate of the first place from which AGREEING frames of one kind follow each other, or as many as there are up to the end."""
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 3:
        place, met, kind = at, 0, None
        while met < AGREEING and (frame := mpeg_frame(data, place)) and kind in (None, frame[2]):
            place, met, kind, rate = place + frame[1], met + 1, frame[2], frame[0]
        if met == AGREEING or met and place >= len(data):
            return rate
        at += 1
    return None


def fields(data: bytes) -> dict:
    if data[:4] in (b"RIFF", b"RIFX") and data[8:12] == b"WAVE":
        return riff_fields(data) if data[:4] == b"RIFF" else {}
    out, end = id3_fields(data)
    return out | {"rate": mpeg_rate(data, end)}


def number(text: str | None) -> int | None:
    """The digits that a track's text starts with, as in 3/12."""
    digits = (text or "").strip().partition("/")[0]
    return int(digits) if digits.isascii() and digits.isdigit() and len(digits) < 10 else None


def tagged(files: DataFrame) -> DataFrame:
    """(fname, title, artist, album, track, rate) of files (path, content); a title falls back to the file's stem, all else to null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                found = fields(content or b"")
                rows.append((path, *((found.get(k) or "").strip() or None for k in ("title", "artist", "album")), number(found.get("track")), found.get("rate")))
            yield pd.DataFrame(rows, columns=["fname", "title", "artist", "album", "track", "rate"]).astype({"track": "Int32", "rate": "Int32"})

    out = files.select("path", "content").mapInPandas(run, "fname string, title string, artist string, album string, track int, rate int")
    return out.withColumn("title", F.coalesce("title", stem(F.col("fname"))))
