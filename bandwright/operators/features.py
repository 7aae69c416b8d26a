"""From audio files to track histograms, one task a file and no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from bandwright.config import DEFAULT, EngineConfig
from bandwright.functions.scales import band_edges, band_of_bin, loudness_weights
from bandwright.operators.frames import GAIN
from bandwright.operators.signal import first_note_bin, note_of_bin
from bandwright.sources.files import DECODERS


#: Frames of the harmonic pipeline: a band for each bin.
HARMONIC = EngineConfig(bands=0, window=4096, step=2048)


@lru_cache(maxsize=16)
def tables(config: EngineConfig, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window, the bands that have bins, where their bins start behind bin 0, and loudness weights; kept by the worker."""
    edges = band_edges(config.bands, config.scale)
    table = np.array(band_of_bin(config.window, rate, edges))[1:]  # ascending
    starts = np.flatnonzero(np.diff(table, prepend=-1))
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(config.window) / (config.window - 1))), table[starts], starts, np.array(loudness_weights(edges))


def band_frames(samples: np.ndarray, rate: int, config: EngineConfig = DEFAULT, at_once: int | None = None) -> Iterator[np.ndarray]:
    """Band values of the hop frames, some hundred frames at a time, more of small windows."""
    window, bands, starts, weights = tables(config, rate)
    at_once = at_once or max(256, (1 << 19) // config.window)
    count = max(0, -(-(len(samples) - config.window) // config.step))
    hops = np.lib.stride_tricks.sliding_window_view(samples, config.window)[:: config.step] if count else None
    for first in range(0, count, at_once):
        spectrum = np.fft.rfft(hops[first : min(first + at_once, count)] * window)[:, 1:]
        power = np.zeros((len(spectrum), config.bands))
        power[:, bands] = np.add.reduceat(spectrum.real**2 + spectrum.imag**2, starts, axis=1)
        yield GAIN * weights * np.sqrt(power) / config.window


def histogram(samples: np.ndarray, rate: int, config: EngineConfig = DEFAULT) -> tuple[int, np.ndarray | None]:
    """(non-silent frames, bands x bins histogram); no histogram below config.min_frames."""
    counts, frames = np.zeros((config.bands, config.bins)), 0
    for values in band_frames(samples, rate, config):
        values = values[(values != 0).any(axis=1)]
        unit = np.clip((values - config.low) / (config.high - config.low), 0, 1 - 1 / config.bins)
        for band in range(config.bands):
            counts[band] += np.bincount((unit[:, band] * config.bins).astype(int), minlength=config.bins)
        frames += len(values)
    return frames, counts / frames if frames >= max(1, config.min_frames) else None


def tracks_of(files: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(fname, length, frames, spect_hist, error) of files (path, content), decoded by their extension.

    A file that cannot be read, or is too short, has an error and no histogram; the others go on.
    """
    decoders = dict(DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    decode = decoders[path.rpartition(".")[2].lower()]
                    rate, samples = decode(content)
                    frames, hist = histogram(samples, rate, config)
                    out.append((path, len(samples) // rate, frames, None if hist is None else hist.tolist(), "too short" if hist is None else None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the ingest
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["fname", "length", "frames", "spect_hist", "error"]).astype({"length": "Int32", "frames": "Int64"})

    return files.select("path", "content").mapInPandas(run, "fname string, length int, frames long, spect_hist array<array<double>>, error string")


@lru_cache(maxsize=16)
def note_table(bins: int, window: int, rate: int) -> tuple[int, np.ndarray, np.ndarray]:
    """First bin that has a note, the notes of the bins from there on, and where each note's bins start."""
    first = first_note_bin(window, rate)
    notes = np.array([note_of_bin(i, window, rate) for i in range(first, bins)])  # ascending
    return first, notes, np.flatnonzero(np.diff(notes, prepend=notes[0] - 1))


def activations(values: np.ndarray, window: int, rate: int, harmonics: int) -> tuple[int, np.ndarray]:
    """(first note, frames x notes of 0 and 1) of frames x bins: products of each bin with its multiples, set where at least 3/4 of the frame's largest, by semitone."""
    bins = values.shape[1]
    products = values.copy()
    for k in range(2, harmonics + 1):
        reached = -(-bins // k)
        products[:, :reached] *= values[:, ::k]
        products[:, reached:] = 0  # past the end
    top = products >= 0.75 * np.maximum(0, products.max(axis=1, keepdims=True))
    first, notes, starts = note_table(bins, window, rate)
    out = np.zeros((len(values), notes[-1] - notes[0] + 1), np.int32)
    out[:, notes[starts] - notes[0]] = np.logical_or.reduceat(top[:, first:], starts, axis=1)
    return int(notes[0]), out


NOTE_FRAMES = pa.schema([("fname", pa.string()), ("frame_no", pa.int32()), ("first_note", pa.int32()), ("active", pa.list_(pa.int32())), ("error", pa.string())])


def note_frames(files: DataFrame, config: EngineConfig = HARMONIC, harmonics: int = 3) -> DataFrame:
    """(fname, frame_no, first_note, active, error) of files (path, content): for each hop frame the notes from first_note on, 1 where active.

    Some hundred frames are in memory at a time. A file that cannot be read has one row with an error; one shorter than a
    window has none.
    """
    decoders = dict(DECODERS)

    def frames(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rate, samples = decoders[path.rpartition(".")[2].lower()](content)
        at = 0
        for values in band_frames(samples, rate, config):
            first, active = activations(values, config.window, rate, harmonics)
            n, width = active.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(active.ravel()))
            yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.repeat(pa.scalar(first, pa.int32()), n), lists, pa.nulls(n, pa.string())], schema=NOTE_FRAMES)
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, content = path.as_py(), content.as_py()
                try:
                    yield from frames(path, content)
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    yield pa.RecordBatch.from_pylist([{"fname": path, "error": f"{type(e).__name__}: {e}"}], schema=NOTE_FRAMES)

    return files.select("path", "content").mapInArrow(run, "fname string, frame_no int, first_note int, active array<int>, error string")
