"""Files as inputs: listing, suffix rules, PCM decoding, path lists, and the legacy track file."""

from __future__ import annotations

import hashlib
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.config import DEFAULT, EngineConfig

#: Decoders by extension, the last registered first: bytes to (rate, mono samples).
DECODERS: dict[str, Callable[[bytes], tuple[int, np.ndarray]]] = {}
CHUNK = 16384


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder of this run that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, folder: str, named: Callable[[pd.DataFrame], Iterator[tuple[str, bytes]]]) -> int:
    """Writes what named gives for each batch of rows, (name, content), into folder; the number of files. A repeated task writes the same names again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, inside = fs.FileSystem.from_uri(folder)
        where.create_dir(inside, recursive=True)
        for b in batches:
            count = 0
            for name, content in named(b):
                with where.open_output_stream(f"{inside}/{name}", compression=None) as out:
                    out.write(content)
                count += 1
            yield pd.DataFrame({"files": [count]})

    return rows.mapInPandas(run, "files long").agg(F.sum("files")).first()[0] or 0


def created(folder: str) -> None:
    where, inside = fs.FileSystem.from_uri(folder)
    where.create_dir(inside, recursive=True)


def removed(folder: str) -> None:
    where, inside = fs.FileSystem.from_uri(folder)
    where.delete_dir(inside)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files below folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def register(extension: str, decode: Callable[[bytes], tuple[int, np.ndarray]]) -> None:
    DECODERS.pop(extension, None)
    DECODERS[extension] = decode


def supported(most: int | None = None) -> list[str]:
    return list(reversed(DECODERS))[:most]


def extension(path: Column) -> Column:
    """Text after the last dot, lower-cased; without a dot the whole path."""
    return F.lower(F.substring_index(path, ".", -1))


def has_extension(path: Column, wanted: list[str], prefix: bool = False) -> Column:
    """Whether a path ends in one of the extensions; with prefix the shorter of both texts decides, so x.mp and x.mp3a fit mp3."""
    own, out = extension(path), F.lit(False)
    for w in wanted:
        out = out | ((F.lit(w).startswith(own) | own.startswith(w)) if prefix else (own == w) & path.contains("."))
    return out


def listing(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path) of the files below folder with one of the extensions."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.where(has_extension(F.col("path"), extensions))


def path_list(spark: SparkSession, file: str) -> DataFrame:
    """(path): the lines of a text file without white space at their end; empty ones are left out."""
    return spark.read.text(file).select(F.rtrim("value").alias("path")).where("path <> ''")


def local_path(url: Column) -> Column:
    return F.regexp_replace(url, "^file://", "")


def stem(path: Column) -> Column:
    """The last part of a path without its extension. The expression, which tries each place, sees the last part alone."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"([^/]+?)(\.[^./]*)?$", 1)


def tags(rows: DataFrame) -> DataFrame:
    """title falls back to the file's stem."""
    return rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), stem(F.col("fname"))))


# Encoding, numpy type, offset of silence, largest magnitude.
ENCODINGS = {
    "s8": ("<i1", 0.0, 128.0), "u8": ("<u1", 128.0, 128.0), "s16": ("<i2", 0.0, 32768.0), "u16": ("<u2", 32768.0, 32768.0),
    "s32": ("<i4", 0.0, 2147483648.0), "u32": ("<u4", 2147483648.0, 2147483648.0), "f32": ("<f4", 0.0, 1.0), "f64": ("<f8", 0.0, 1.0),
}


def mono(data: bytes, encoding: str, channels: int, mixdown: str = "mean") -> np.ndarray:
    """Interleaved PCM as mono samples in [-1, 1]; mixdown "sum" adds the channels up. An incomplete last frame is dropped."""
    if encoding not in ENCODINGS or channels < 1 or mixdown not in ("mean", "sum"):
        raise ValueError("unsupported encoding, channel count or mixdown")
    kind, silence, most = ENCODINGS[encoding]
    size = np.dtype(kind).itemsize * channels
    values = np.frombuffer(data[: len(data) // size * size], kind).astype(float).reshape(-1, channels)
    values = (values - silence) / most
    return values.mean(axis=1) if mixdown == "mean" else values.sum(axis=1)


def decode_pcm(files: DataFrame, encoding: str = "f32", channels: int = 1, rate: int = 44100, mixdown: str = "mean") -> DataFrame:
    """(path, chunk_no, frate, samples) of raw PCM in files (path, content), in chunks of CHUNK samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                x = mono(content, encoding, channels, mixdown).astype(np.float32)
                parts = [x[i : i + CHUNK] for i in range(0, len(x), CHUNK)]
                yield pd.DataFrame({"path": [path] * len(parts), "chunk_no": range(len(parts)), "frate": [rate] * len(parts), "samples": parts})

    return files.select("path", "content").mapInPandas(run, "path string, chunk_no int, frate int, samples array<float>")


# The legacy track file has 14 four-byte header fields, then rows of fixed width.
MAGIC, VERSION = (0xDEADBEEF, 0xBEEFCAFE), 0x00010001
WIDTHS = (256, 64, 64, 64)


def legacy_header(rows: int, config: EngineConfig = DEFAULT) -> bytes:
    return struct.pack("<11I2fI", MAGIC[0], VERSION, rows, *WIDTHS, config.bands, config.bins, config.window, config.step, config.low, config.high, MAGIC[1])


def legacy_bytes(rows: list, config: EngineConfig = DEFAULT) -> bytes:
    """Rows (fname, title, artist, album, track, length, hist) as a file; texts are cut to their width less one byte; exclude is 0."""
    out = [legacy_header(len(rows), config)]
    for r in rows:
        texts = b"".join((v or "").encode()[: w - 1].ljust(w, b"\0") for v, w in zip(r[:4], WIDTHS, strict=True))
        out.append(texts + struct.pack("<2Ii", r[4] or 0, r[5] or 0, 0) + np.asarray(r[6], "<f4").tobytes())
    return b"".join(out)


def legacy_rows(data: bytes, config: EngineConfig = DEFAULT) -> Iterator[tuple]:
    head = struct.calcsize("<11I2fI")
    found = struct.unpack("<11I2fI", data[:head])
    if data[:head] != legacy_header(found[2], config) or not found[2]:
        raise ValueError("the header does not fit the configuration, or there are no rows")
    kind = np.dtype([("texts", "S1", (sum(WIDTHS),)), ("numbers", "<u4", (3,)), ("hist", "<f4", (config.bands, config.bins))])
    for r in np.frombuffer(data, kind, found[2], head):
        raw, at, texts = r["texts"].tobytes(), 0, []
        for w in WIDTHS:
            texts.append(raw[at : at + w].split(b"\0")[0].decode(errors="ignore"))
            at += w
        yield (*texts, int(r["numbers"][0]), int(r["numbers"][1]), r["hist"].tolist())


def write_legacy(tracks: DataFrame, folder: str, config: EngineConfig = DEFAULT) -> int:
    """Writes tracks (fname, title, artist, album, track, length, hist) as files of the legacy format, one for each batch of a task; the number of files."""

    def named(b: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        if len(b):
            content = legacy_bytes([(*r[:6], [list(x) for x in r[6]]) for r in b.itertuples(index=False)], config)
            yield f"{hashlib.sha256(content).hexdigest()}.db", content

    return write_files(tracks.select("fname", "title", "artist", "album", "track", "length", "hist"), folder, named)


LEGACY = "fname string, title string, artist string, album string, track int, length int, spect_hist array<array<float>>, exclude boolean"


def read_legacy(spark: SparkSession, path: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """The rows of legacy files, exclude false throughout."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows = list(legacy_rows(content, config))
                yield pd.DataFrame([(*r, False) for r in rows], columns=["fname", "title", "artist", "album", "track", "length", "spect_hist", "exclude"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, LEGACY)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a RIFF wave file with whole-byte PCM."""
    import io
    import wave

    with wave.open(io.BytesIO(data)) as w:
        kinds = {1: "u8", 2: "s16", 4: "s32"}
        if w.getsampwidth() not in kinds:
            raise ValueError(f"{8 * w.getsampwidth()}-bit samples are not supported")
        return w.getframerate(), mono(w.readframes(w.getnframes()), kinds[w.getsampwidth()], w.getnchannels())


register("wav", decode_wav)
