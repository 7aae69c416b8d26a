import struct

import pytest

from bandwright.sources import tags


def chunk(name, body):
    return struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


FMT = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 22050, 44100, 2, 16))


def safe(n):
    return bytes(n >> 7 * k & 0x7F for k in (3, 2, 1, 0))


def id3(version, *frames, flags=0):
    body = b"".join(frames)
    return b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body


def frame(version, name, text, encoding):
    value = bytes([encoding]) + text.encode(tags.ENCODINGS[encoding])
    if version == 2:
        return name + len(value).to_bytes(3, "big") + value
    return name + (safe(len(value)) if version == 4 else len(value).to_bytes(4, "big")) + b"\0\0" + value


def mpeg(n, head=b"\xff\xfb\x90\x00"):  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz
    size = tags.mpeg_frame(head, 0)[1]
    return (head + b"\0" * (size - 4)) * n


def test_riff():
    info = chunk(b"LIST", b"INFO" + chunk(b"INAM", "Été\0".encode()) + chunk(b"IART", b"caf\xe9") + chunk(b"ITRK", b"7/9"))
    assert tags.fields(riff(FMT, chunk(b"data", b"\0\0\0"), info)) == {"rate": 22050, "title": "Été", "artist": "café", "track": "7/9"}
    assert tags.fields(riff(FMT) + struct.pack("<4sI", b"LIST", 999) + b"INFO" + b"INAM") == {"rate": 22050}


@pytest.mark.parametrize("version", [2, 3, 4])
@pytest.mark.parametrize("encoding", [0, 1, 2, 3])
def test_id3(version, encoding):
    names = (b"TT2", b"TP1", b"TAL", b"TRK") if version == 2 else (b"TIT2", b"TPE1", b"TALB", b"TRCK")
    long = "é" * 200  # its size needs more than seven bits
    data = id3(version, *(frame(version, n, t, encoding) for n, t in zip(names, ("Title", long, "Album", "03"), strict=True)), b"\0" * 20) + mpeg(4)
    assert tags.fields(data) == {"title": "Title", "artist": long, "album": "Album", "track": "03", "rate": 44100}


def test_rate_after_junk():
    assert tags.mpeg_rate(b"\xff\xfb\x90\x00 no frame \xff\xff" + mpeg(3)) == 44100
    assert tags.mpeg_rate(mpeg(3, b"\xff\xf3\x80\x00")) == 22050 and tags.mpeg_rate(mpeg(2, b"\xff\xfd\x94\x00")) == 48000
    assert tags.mpeg_rate(mpeg(1) + b"x" * 50) is None and tags.mpeg_rate(b"") is None and tags.mpeg_rate(b"\xff" * 100) is None
    assert tags.fields(b"ID3") == {"rate": None} and tags.fields(id3(3, b"TIT2\0\0\xff\xff\0\0\x03cut")) == {"title": "cut", "rate": None}


def test_rows(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(riff(FMT, chunk(b"LIST", b"INFO" + chunk(b"INAM", b" A "))))
    (tmp_path / "b.mp3").write_bytes(id3(3, frame(3, b"TRCK", "12/20", 0)) + mpeg(3))
    (tmp_path / "c.raw").write_bytes(b"\0")
    rows = tags.tagged(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("fname").collect()
    assert [tuple(r)[1:] for r in rows] == [("A", None, None, None, 22050), ("b", None, None, 12, 44100), ("c", None, None, None, None)]
