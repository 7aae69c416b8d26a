"""Audio files as a Spark data source, and track and raster files as sinks that commit whole jobs.

    register(spark)
    spark.read.format("bandwright.audio").option("extensions", "wav").load(folder).where("path like '%/a%'")
    tracks.write.format("bandwright.tracks").mode("overwrite").option("bands", 24).save(folder)
    images.write.format("bandwright.raster").mode("overwrite").option("inverted", "true").save(folder)

Folders are URIs of any store that pyarrow's file systems know, or local paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from bandwright.config import DEFAULT, EngineConfig
from bandwright.sources.files import CHUNK, DECODERS, legacy_bytes, mono

#: Bytes that a partition of the audio source reads about; a file is cut at chunks where its format allows.
PARTITION_BYTES = 32 << 20
AUDIO = "path string, chunk_no int, frate int, samples array<float>, error string"
TRACKS = "fname string, title string, artist string, album string, track int, length int, hist array<array<double>>"
RASTER = "name string, rows array<array<double>>"
STAGING = "_staging"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def said(options, name: str, default: str = "false") -> bool:
    return options.get(name, default).lower() == "true"


# Reading


@dataclass
class Piece(InputPartition):
    """Shares of files: (path, number of the share, shares of that file)."""

    shares: list[tuple[str, int, int]]


def wave_chunks(stream, share: int, shares: int, chunk: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(chunk_no, rate, samples) of a share of a wave file's chunks; only their bytes are read."""
    import wave

    with wave.open(stream) as w:
        kinds = {1: "u8", 2: "s16", 4: "s32"}
        if w.getsampwidth() not in kinds:
            raise ValueError(f"{8 * w.getsampwidth()}-bit samples are not supported")
        chunks = -(-w.getnframes() // chunk)
        first, last = chunks * share // shares, chunks * (share + 1) // shares
        if first < last:
            w.setpos(first * chunk)
        for k in range(first, last):
            yield k, w.getframerate(), mono(w.readframes(chunk), kinds[w.getsampwidth()], w.getnchannels())


class AudioReader(DataSourceReader):
    def __init__(self, options, decoders: dict):
        self.path, self.decoders = options["path"], decoders
        self.extensions = [e.strip().lower() for e in options.get("extensions", ",".join(decoders)).split(",")]
        self.chunk, self.size = int(options.get("chunk", CHUNK)), int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on the path are met by the listing, so that other files are not opened; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def fits(self, path: str) -> bool:
        checks = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: lambda v: v in path}
        return path.rpartition(".")[2].lower() in self.extensions and "." in path and all(checks[type(f)](f.value) for f in self.tests)

    def partitions(self) -> list[Piece]:
        """Small files together, large wave files in shares."""
        where, inside = opened(self.path)
        root = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        info = where.get_file_info(inside)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inside, recursive=True))
        out, pending, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            if not self.fits(path := root + f.path):
                continue
            shares = max(1, -(-f.size // self.size)) if path.lower().endswith(".wav") else 1
            if shares > 1:
                out += [Piece([(path, k, shares)]) for k in range(shares)]
                continue
            pending.append((path, 0, 1))
            size += f.size
            if size >= self.size:
                out.append(Piece(pending))
                pending, size = [], 0
        return [*out, Piece(pending)] if pending or not out else out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string()]
        names = ["path", "chunk_no", "frate", "samples", "error"]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)
        for path, share, shares in partition.shares:
            try:
                for k, rate, x in self.chunks(path, share, shares):
                    yield row(path, k, rate, x.astype(np.float32), None)
            except Exception as e:  # noqa: BLE001  one bad file must not end the job; its row says why
                if share == 0:
                    yield row(path, None, None, None, f"{type(e).__name__}: {e}")

    def chunks(self, path: str, share: int, shares: int) -> Iterator[tuple[int, int, np.ndarray]]:
        where, inside = opened(path)
        extension = path.rpartition(".")[2].lower()
        with where.open_input_file(inside) as stream:
            if extension == "wav":
                yield from wave_chunks(stream, share, shares, self.chunk)
                return
            rate, x = self.decoders[extension](stream.read())
            for k, at in enumerate(range(0, len(x), self.chunk)):
                yield k, rate, x[at : at + self.chunk]


class AudioSource(DataSource):
    """Chunks of decoded audio files: path, chunk_no, frate, samples, and error for a file that can't be read.

    Options: extensions (comma-separated, else all that have a decoder), chunk (samples), partitionBytes.
    """

    decoders: dict = DECODERS

    @classmethod
    def name(cls) -> str:
        return "bandwright.audio"

    def schema(self) -> str:
        return AUDIO

    def reader(self, schema: StructType) -> DataSourceReader:
        return AudioReader(self.options, dict(self.decoders))


# Writing


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has staged."""

    names: list[str]


class Staged(DataSourceWriter):
    """A sink whose tasks write into a folder of the job; its files go to their place when all tasks are done.

    A failed job leaves no file. With overwrite the files of before go only then. Names of a job's files differ by task, so
    a task that is run again leaves nothing of its first try: what no message names goes with the staging folder.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def files(self, rows: Iterator[Row], part: str) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def staging(self) -> tuple[fs.FileSystem, str, str]:
        where, inside = opened(self.path)
        return where, inside.rstrip("/"), f"{inside.rstrip('/')}/{STAGING}/{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        where, _, staging = self.staging()
        task = TaskContext.get()
        own = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        where.create_dir(f"{staging}/{own}", recursive=True)
        names = []
        for name, content in self.files(rows, f"{task.partitionId():05d}"):
            with where.open_output_stream(f"{staging}/{own}/{name}", compression=None) as out:
                out.write(content)
            names.append(f"{own}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, inside, staging = self.staging()
        new = [n for m in messages if m for n in m.names]
        if len({n.partition("/")[2] for n in new}) < len(new):
            self.abort(messages)
            raise ValueError("two rows give files of one name")
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    where.delete_file(f.path)
        for n in new:
            where.move(f"{staging}/{n}", f"{inside}/{n.partition('/')[2]}")
        self.clear()
        with where.open_output_stream(f"{inside}/_SUCCESS", compression=None):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        where, inside, staging = self.staging()
        if where.get_file_info(staging).type == fs.FileType.Directory:
            where.delete_dir(staging)
        parent = f"{inside}/{STAGING}"
        if where.get_file_info(parent).type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(parent)):
            where.delete_dir(parent)


class TrackWriter(Staged):
    def __init__(self, path: str, overwrite: bool, config: EngineConfig, rows: int):
        super().__init__(path, overwrite)
        self.config, self.rows = config, rows

    def files(self, rows: Iterator[Row], part: str) -> Iterator[tuple[str, bytes]]:
        pending, count = [], 0

        def one() -> tuple[str, bytes]:
            return f"part-{part}-{count:05d}-{self.job}.hdb", legacy_bytes(pending, self.config)

        for r in rows:
            hist = np.asarray(r["hist"], float)
            if hist.shape != (self.config.bands, self.config.bins):
                raise ValueError(f"{r['fname']}: a histogram of {hist.shape} does not fit the configuration")
            pending.append((r["fname"], r["title"], r["artist"], r["album"], r["track"], r["length"], hist))
            if len(pending) >= self.rows:
                yield one()
                pending, count = [], count + 1
        if pending:
            yield one()


class TrackFiles(DataSource):
    """Sink: files of the legacy track format, exclude 0. Options: the fields of EngineConfig, and rows (a file)."""

    @classmethod
    def name(cls) -> str:
        return "bandwright.tracks"

    def schema(self) -> str:
        return TRACKS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        given = {f.name: type(getattr(DEFAULT, f.name))(self.options[f.name]) for f in fields(EngineConfig) if f.name in self.options}
        return TrackWriter(self.options["path"], overwrite, replace(DEFAULT, **given), int(self.options.get("rows", "1000")))


def picture(values: np.ndarray, colored: bool = False, inverted: bool = False) -> bytes:
    """A PGM file of values in [0, 1], or a PPM file with 24 bits of each value as red, green and blue, low byte first; inverted takes each byte from 255."""
    most = 0xFFFFFF if colored else 0xFF
    whole = np.floor(np.nan_to_num(np.clip(values, 0, 1)) * most).astype("<u4")
    cells = whole.view("u1").reshape(*whole.shape, 4)[..., : 3 if colored else 1]
    head = f"P{6 if colored else 5}\n{whole.shape[1]} {whole.shape[0]}\n255\n"
    return head.encode() + (255 - cells if inverted else cells).tobytes()


class RasterWriter(Staged):
    def __init__(self, path: str, overwrite: bool, colored: bool, inverted: bool):
        super().__init__(path, overwrite)
        self.colored, self.inverted = colored, inverted

    def files(self, rows: Iterator[Row], part: str) -> Iterator[tuple[str, bytes]]:
        for r in rows:
            if not r["name"] or "/" in r["name"] or r["name"].startswith("_"):
                raise ValueError(f"no name of a file: {r['name']!r}")
            values = np.asarray(r["rows"], float)
            yield f"{r['name']}.{'ppm' if self.colored else 'pgm'}", picture(values.reshape(len(r["rows"]), -1), self.colored, self.inverted)


class RasterFiles(DataSource):
    """Sink: a PGM or PPM file for each row (name, rows). Options: colored, inverted."""

    @classmethod
    def name(cls) -> str:
        return "bandwright.raster"

    def schema(self) -> str:
        return RASTER

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RasterWriter(self.options["path"], overwrite, said(self.options, "colored"), said(self.options, "inverted"))


def options_of(config: EngineConfig) -> dict[str, str]:
    return {k: str(v) for k, v in asdict(config).items()}


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach the audio source's listing.

    Readers are made in processes of their own, so the decoders that are registered by now go with the source's class.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (type("KnownAudio", (AudioSource,), {"decoders": dict(DECODERS)}), TrackFiles, RasterFiles):
        spark.dataSource.register(source)
