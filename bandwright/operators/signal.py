"""Tempo, harmonics, wavelets and the Gabor transform."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


MIN_BPM = 5.0
#: C of the octave that notes count from, and of the lowest octave, in Hz.
NOTE_BASE, LOWEST_C = 130.812, 16.352
#: Relative size at which a Gabor kernel is cut off, and the octave that its scales start from.
GABOR_ERROR, FIRST_OCTAVE = 1e-4, 2

#: Samples of a Gabor block at least, and rows that a task gives at once about.
LEAST_BLOCK, GABOR_ROWS = 1 << 14, 1 << 16

# The four Daubechies coefficients.
_R3, _N = math.sqrt(3), 4 * math.sqrt(2)
D4 = ((1 + _R3) / _N, (3 + _R3) / _N, (3 - _R3) / _N, (1 - _R3) / _N)


def level(values: Column) -> Column:
    """One forward D4 level of an array of even length of at least 4: smooth half, then detail half. Periodic."""
    n, (a, b, c, d) = F.size(values), D4
    at = lambda i: F.element_at(values, F.pmod(i, n).cast("int") + 1)
    half = F.sequence(F.lit(0), (n / 2).cast("int") - 1)
    low = F.transform(half, lambda i: at(2 * i) * a + at(2 * i + 1) * b + at(2 * i + 2) * c + at(2 * i + 3) * d)
    high = F.transform(half, lambda i: at(2 * i) * d - at(2 * i + 1) * c + at(2 * i + 2) * b - at(2 * i + 3) * a)
    return F.concat(low, high)


def inverse_level(values: Column) -> Column:
    """Undoes level()."""
    n, (a, b, c, d) = F.size(values), D4
    half = (n / 2).cast("int")
    smooth = lambda i: F.element_at(values, F.pmod(i, half).cast("int") + 1)
    detail = lambda i: F.element_at(values, F.pmod(i, half).cast("int") + 1 + half)
    even = lambda i: smooth(i - 1) * c + detail(i - 1) * b + smooth(i) * a + detail(i) * d
    odd = lambda i: smooth(i - 1) * d - detail(i - 1) * a + smooth(i) * b - detail(i) * c
    return F.flatten(F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.array(even(i), odd(i))))


def forward_matrix(n: int) -> np.ndarray:
    m = np.zeros((n, n))
    a, b, c, d = D4
    for i in range(n // 2):
        for k, (s, t) in enumerate(((a, d), (b, -c), (c, b), (d, -a))):
            m[i, (2 * i + k) % n] += s
            m[i + n // 2, (2 * i + k) % n] += t
    return m


def wavelet(rows: DataFrame, column: str, inverse: bool = False) -> DataFrame:
    """All D4 levels of an array column, its length rounded down to a power of two; shorter than 4 stays. Arrow batches."""

    def one(v: np.ndarray) -> np.ndarray:
        n = 1 << (len(v).bit_length() - 1) if len(v) else 0
        out = np.array(v[:n], float)
        sizes = [1 << k for k in range(2, n.bit_length())]
        for size in sizes if inverse else sizes[::-1]:
            m = forward_matrix(size)
            out[:size] = (m.T if inverse else m) @ out[:size]
        return out

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return rows.withColumn(column, run(F.col(column)))


def harmonic_product(values: Column, harmonics: int = 3) -> Column:
    """Product of each bin i with bins 2i, 3i, .. ; 0 past the end. Then 1 where at least 3/4 of the largest product, else 0."""
    at = lambda i: F.coalesce(F.get(values, i), F.lit(0.0))

    def product(v: Column, i: Column) -> Column:
        for k in range(2, harmonics + 1):
            v = v * at(i * k)
        return v

    return F.transform(values, product)


def binarised(products: Column) -> Column:
    limit = F.greatest(F.lit(0.0), F.array_max(products)) * 0.75
    return F.transform(products, lambda p: F.when(p < limit, 0).otherwise(1))


def note_of_bin(i: int, window: int, rate: int) -> int:
    """Semitone above NOTE_BASE of a frequency bin."""
    return math.floor(12 / math.log(2) * (math.log(i) + math.log(rate / (window * NOTE_BASE))))


def first_note_bin(window: int, rate: int) -> int:
    return max(1, int(NOTE_BASE * window / rate))


def notes(rows: DataFrame, column: str, bins: int, window: int, rate: int) -> DataFrame:
    """(track_id, note, active): whether any binarised bin of a semitone is set."""
    table = [note_of_bin(i, window, rate) if i >= first_note_bin(window, rate) else None for i in range(bins)]
    each = rows.select("track_id", F.posexplode(column).alias("bin", "v")).withColumn("note", F.get(F.array(*(F.lit(t).cast("int") for t in table)), F.col("bin")))
    return each.where("note is not null").groupBy("track_id", "note").agg(F.max((F.col("v") > 0).cast("int")).alias("active"))


def tempo_spectrum(series: DataFrame, per_minute: float, compat: bool = False) -> DataFrame:
    """(track_id, f, bpm, power): over bands, sqrt(sum of the bands' spectral power / n); 0 at f = 0 and below MIN_BPM.

    series: (track_id, band, i, value), of equal length in all bands of a track. A band's series is one row and takes one
    FFT of its own length. It stands as (value - least) / largest less the mean, with compat less the sum, as originally
    computed. Power is re^2 + im^2; with compat (re im)^2.
    """
    rows = series.groupBy("track_id", "band").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s")).select("track_id", F.transform("s", lambda x: x["value"]).alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            powers = []
            for v in f["v"]:
                most = max(0.0, v.max())
                unit = (v - v.min()) / most if most else np.zeros(len(v))
                spectrum = np.fft.rfft(unit - (unit.sum() if compat else unit.mean()))
                powers.append((spectrum.real * spectrum.imag) ** 2 if compat else spectrum.real**2 + spectrum.imag**2)
            yield pd.DataFrame({"track_id": f["track_id"], "n": f["v"].map(len), "power": powers})

    found = rows.mapInPandas(run, "track_id long, n long, power array<double>").select("track_id", "n", F.posexplode("power").alias("f", "p"))
    out = found.groupBy("track_id", "f", "n").agg(F.sum("p").alias("p")).withColumn("f", F.col("f").cast("long"))
    bpm = F.col("f") * per_minute / F.col("n")
    return out.select("track_id", "f", bpm.alias("bpm"), F.when((F.col("f") == 0) | (bpm < MIN_BPM), 0.0).otherwise(F.sqrt(F.col("p") / F.col("n"))).alias("power"))


def gabor_octaves(rate: int, highest: float = 8500.0) -> int:
    return max(0, int(math.log2(min(rate / 2, highest) / LOWEST_C)))


def gabor_kernel(k: int, rate: int) -> tuple[np.ndarray, int]:
    """The values that samples u + first, u + first + 1, .. are weighed with at semitone k, and first."""
    den = 2 ** (-k / 12)
    reach = math.sqrt(2 * math.log(1 / GABOR_ERROR)) * den * rate
    first, stop = -math.ceil(reach), math.floor(reach)
    t = np.arange(first, stop) / rate / den
    return np.exp(-0.5 * t * t + 2j * np.pi * LOWEST_C * t) / math.sqrt(den), first


def gabor(stream: DataFrame, rate: int, step: int) -> DataFrame:
    """(track_id, k, u, power): magnitude of the Gabor transform at semitone k and sample u = 0, step, 2 step, ..

    stream: (track_id, pos, n, value). Streams are cut into blocks, each with as many samples of its neighbours as the widest
    kernel reaches; a block takes one FFT, and a product and an inverse FFT for each semitone, whatever the kernel's width.
    """
    notes = range(12 * FIRST_OCTAVE, 12 * gabor_octaves(rate))
    if not notes:
        raise ValueError("the rate is too low for any octave")
    halo = len(gabor_kernel(notes[0], rate)[0])
    block = step * -(-max(LEAST_BLOCK, 4 * halo) // step)
    last = F.floor((F.col("n") - 1) / block)
    reached = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - halo) / block)), F.least(last, F.floor((F.col("pos") + halo) / block)))
    each = stream.withColumn("block", F.explode(reached)).groupBy("track_id", "block", "n").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    each = each.select("track_id", "block", "n", "first", F.transform("s", lambda x: x["value"]).alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels = [gabor_kernel(k, rate) for k in notes]
        spectra: dict[int, list[np.ndarray]] = {}
        pending, size_of = [], 0

        def packed() -> pd.DataFrame:
            counts = [len(u) for _, _, u, _ in pending]
            return pd.DataFrame({
                "track_id": np.repeat([t for t, *_ in pending], counts), "k": np.repeat([k for _, k, *_ in pending], counts),
                "u": np.concatenate([u for _, _, u, _ in pending]), "power": np.concatenate([p for *_, p in pending]),
            })

        for f in frames:
            for r in f.itertuples(index=False):
                size = 1 << (len(r.v) + halo).bit_length()
                if size not in spectra:
                    spectra[size] = [np.fft.fft(h[::-1], size) for h, _ in kernels]  # some ten sizes, as blocks are bounded
                x = np.fft.fft(r.v, size)
                u = np.arange(r.block * block, min((r.block + 1) * block, r.n), step)
                for k, (h, first), own in zip(notes, kernels, spectra[size], strict=True):
                    place = u - r.first + first + len(h) - 1  # where the reversed kernel's sum for u stands
                    pending.append((r.track_id, k, u, np.abs(np.fft.ifft(x * own)[place])))
                    size_of += len(u)
                if size_of >= GABOR_ROWS:  # a batch of many short streams, not one for each
                    yield packed()
                    pending, size_of = [], 0
        if pending:
            yield packed()

    return each.mapInPandas(run, "track_id long, k int, u long, power double")


def trajectory(frames: DataFrame) -> DataFrame:
    """(track_id, frame_no, x, y, z) of three-band frames that are not near zero."""
    return frames.where(~F.forall("bands", lambda x: F.abs(x) <= 1e-5)).select("track_id", "frame_no", *(F.get("bands", F.lit(i)).alias(c) for i, c in enumerate("xyz")))


def spectrum_text(frames: DataFrame) -> DataFrame:
    """(track_id, frame_no, line): a frame's bands with four decimals."""
    return frames.select("track_id", "frame_no", F.array_join(F.transform("bands", lambda x: F.format_string("%.4f", x)), " ").alias("line"))


def series_of(frames: DataFrame) -> DataFrame:
    """(track_id, band, i, value): frames turned into a series for each band, i counting the track's frames."""
    rows = frames.select("track_id", (F.row_number().over(W.partitionBy("track_id").orderBy("frame_no")) - 1).alias("i"), "bands")
    return rows.select("track_id", "i", F.posexplode("bands").alias("band", "value"))


