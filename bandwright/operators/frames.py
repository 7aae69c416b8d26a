"""From sample streams to band-power frames and normalised histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.functions.arrays import bin_of
from bandwright.functions.scales import band_edges, band_of_bin, loudness_weights

GAIN = 8.0


def positions(samples: DataFrame) -> DataFrame:
    """(track_id, pos, n, value): place of each sample in its stream by (ts, event_id), and the stream's length."""
    w = W.partitionBy("track_id")
    return samples.select("track_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("pos"), F.count("*").over(w).alias("n"), "value")


def framed(samples: DataFrame, window: int, step: int) -> DataFrame:
    """(track_id, frame_no, k, value): sample k of each hop frame.

    Frame f covers [f * step, f * step + window) and exists if f * step + window < n; the tail is dropped. Each sample
    goes to the ceil(window / step) frames that may cover it, by arithmetic on its place.
    """
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - window) / step) + 1)
    each = positions(samples).withColumn("frame_no", F.explode(F.sequence(first, last)))
    return each.where(F.col("frame_no") * step + window < F.col("n")).select("track_id", F.col("frame_no").cast("int"), (F.col("pos") - F.col("frame_no") * step).cast("int").alias("k"), "value")


def hann(k: Column, window: int) -> Column:
    """Symmetric Hann weight of sample k."""
    return 0.5 * (1 - F.cos(2 * np.pi * k / (window - 1)))


def dft_power(samples: DataFrame, window: int, step: int) -> DataFrame:
    """(track_id, frame_no, bin, power) by a plain DFT in expressions: for small windows; rfft_power() is for large ones."""
    angle = -2 * np.pi * F.col("bin") * F.col("k") / window
    x = F.col("value") * hann(F.col("k"), window)
    each = framed(samples, window, step).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(window // 2))))
    sums = each.groupBy("track_id", "frame_no", "bin").agg(F.sum(x * F.cos(angle)).alias("re"), F.sum(x * F.sin(angle)).alias("im"))
    return sums.select("track_id", "frame_no", "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def rfft_power(samples: DataFrame, window: int, step: int) -> DataFrame:
    """As dft_power(), by numpy's FFT over Arrow batches of whole frames."""
    rows = framed(samples, window, step).groupBy("track_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    rows = rows.select("track_id", "frame_no", F.transform("s", lambda x: x["value"]).alias("v"))
    weights = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / (window - 1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                spectrum = np.fft.rfft(np.stack(f["v"].to_numpy()) * weights)
                yield pd.DataFrame({"track_id": f["track_id"], "frame_no": f["frame_no"], "power": list(spectrum.real**2 + spectrum.imag**2)})

    return rows.mapInPandas(run, "track_id long, frame_no int, power array<double>").select("track_id", "frame_no", F.posexplode("power").alias("bin", "power"))


def band_power(power: DataFrame, window: int, rate: int, bands: int, scale: str = "mel", weighted: bool = True) -> DataFrame:
    """(track_id, frame_no, band, value): GAIN * weight * sqrt(sum of the band's bins) / window; bin 0 is left out. All bands are present."""
    edges = band_edges(bands, scale)
    table = band_of_bin(window, rate, edges)
    weights = loudness_weights(edges) if weighted else [1.0] * bands
    band = F.get(F.array(*map(F.lit, table)), F.col("bin"))
    sums = [F.sum(F.when((F.col("band") == b) & (F.col("bin") > 0), F.col("power")).otherwise(0.0)) for b in range(bands)]
    values = F.array(*(GAIN * weights[b] * F.sqrt(s) / window for b, s in enumerate(sums)))
    wide = power.withColumn("band", band).groupBy("track_id", "frame_no").agg(values.alias("values"))
    return wide.select("track_id", "frame_no", F.posexplode("values").alias("band", "value"))


def cepstrum(power: DataFrame, window: int, rate: int, outputs: int, scale: str = "mel") -> DataFrame:
    """(track_id, frame_no, q, value): DFT of the log band powers of 2 (outputs - 1) bands, GAIN * magnitude / bands. A zero band counts as 0."""
    bands = 2 * (outputs - 1)
    logs = band_power(power, window, rate, bands, scale).withColumn("x", F.when(F.col("value") != 0, F.ln("value")).otherwise(0.0))
    angle = -2 * np.pi * F.col("q") * F.col("band") / bands
    each = logs.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))))
    sums = each.groupBy("track_id", "frame_no", "q").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return sums.select("track_id", "frame_no", "q", (GAIN * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / bands).alias("value"))


def loud(frames: DataFrame) -> DataFrame:
    """Frames of which any band is not 0."""
    return frames.where(F.exists("bands", lambda x: x != 0))


def enough(frames: DataFrame, min_frames: int) -> DataFrame:
    """(track_id, n) of tracks with at least min_frames non-silent frames."""
    return loud(frames).groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_frames)


def histogram_counts(frames: DataFrame, bins: int) -> DataFrame:
    """(track_id, band, bin, count) over non-silent frames, zeros included. Counted by bin, then spread out."""
    each = loud(frames).select("track_id", F.posexplode("bands").alias("band", "v")).select("track_id", "band", bin_of(F.col("v"), bins).alias("bin"))
    counts = each.groupBy("track_id", "band").agg(F.array(*(F.count(F.when(F.col("bin") == b, 1)) for b in range(bins))).alias("counts")) if bins <= 32 else (
        each.groupBy("track_id", "band", "bin").agg(F.count("*").alias("c")).groupBy("track_id", "band").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
        .select("track_id", "band", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0))).alias("counts"))
    )
    return counts.select("track_id", "band", F.posexplode("counts").alias("bin", "count"))


def histograms(frames: DataFrame, bins: int, min_frames: int = 0) -> DataFrame:
    """(track_id, band, bin, p): counts divided by the track's non-silent frames, so each band sums to 1."""
    frames = loud(frames)
    if min_frames:
        frames = frames.join(enough(frames, min_frames).select("track_id"), "track_id", "left_semi")
    counts = histogram_counts(frames, bins)
    return counts.select("track_id", "band", "bin", (F.col("count") / F.sum("count").over(W.partitionBy("track_id", "band"))).alias("p"))


def nested(histogram: DataFrame) -> DataFrame:
    """(track_id, hist): long rows (track_id, band, bin, p) as nested arrays."""
    by_band = histogram.groupBy("track_id", "band").agg(F.array_sort(F.collect_list(F.struct("bin", "p"))).alias("h"))
    by_track = by_band.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("band", "h"))).alias("H"))
    return by_track.select("track_id", F.transform("H", lambda b: F.transform(b["h"], lambda x: x["p"])).alias("hist"))


def mean_rate(chunks: DataFrame) -> DataFrame:
    """(track_id, rate): sample-weighted mean frame rate, truncated. chunks: (track_id, frate, length)."""
    return chunks.groupBy("track_id").agg(F.floor(F.sum(F.col("frate") * F.col("length")) / F.sum("length")).cast("long").alias("rate"))
