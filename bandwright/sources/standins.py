"""The engine's inputs, made from the driver's tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.sources.files import created, removed, write_files

BANDS, BINS = 4, 16
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: Bytes and files of wave files that lie in the shared folder at once, and samples of a tone that are made at once.
LOT_BYTES, LOT_FILES, AT_ONCE = 1 << 30, 5_000, 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, hist, exclude): an embedding's absolute values as 4 bands of 16 bins, each band summing to 1."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))

    def band(b):
        own = F.slice(v, b * BINS + 1, BINS)
        return F.transform(own, lambda x: x / F.nullif(F.aggregate(own, F.lit(0.0), lambda a, y: a + y), F.lit(0.0)))

    hist = F.array(*(band(b) for b in range(BANDS)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), hist.alias("hist"), F.lit(False).alias("exclude"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, fname, title, artist, album, track, length, exclude) from parts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"), F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string")).alias("fname"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"), F.col("p_size").alias("track"), (F.col("p_size") * 37).alias("length"), F.lit(False).alias("exclude"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, ts, event_id, value): each user's events as a sample stream."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts", "event_id", "value")


def day_frames(spark: SparkSession, sf_dir: str, loud: float = 0.0) -> DataFrame:
    """(track_id, frame_no, bands): for each user and day the values above loud summed by event type, in thousands."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    sums = [F.sum(F.when((F.col("event_type") == t) & (F.col("value") > loud), F.col("value")).otherwise(0.0)) / 1000 for t in EVENT_TYPES]
    return e.groupBy(F.col("user_id").alias("track_id"), day.alias("frame_no")).agg(F.array(*sums).alias("bands"))


@lru_cache(maxsize=1)
def overtones(pitch_class: int, seconds: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of sin(k a) / k and cos(k a) / k over k = 1 .. 8 at each sample's angle a, each term from the two before it: sin(k a) = 2 cos(a) sin((k - 1) a) - sin((k - 2) a)."""
    pitch = 110.0 * 2 ** (pitch_class / 12)
    out = np.empty((2, seconds * rate))
    for at in range(0, seconds * rate, AT_ONCE):
        a = 2 * np.pi * pitch * (np.arange(at, min(at + AT_ONCE, seconds * rate)) / rate)
        twice = 2 * np.cos(a)
        for row, before, now in ((out[0], 0.0, np.sin(a)), (out[1], 1.0, twice / 2)):
            x = now.copy()
            for k in range(2, 9):
                before, now = now, twice * now - before
                x += now / k
            row[at : at + len(a)] = x
    return out[0], out[1]


def tone(key: int, seconds: int = 10, rate: int = 44100) -> bytes:
    """A wave file of a tone whose pitch depends on the key, with overtones: sin(k a + key) = cos(key) sin(k a) + sin(key) cos(k a), so tones of one pitch that follow each other share their sums."""
    sines, cosines = overtones(key % 36, seconds, rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        for at in range(0, seconds * rate, AT_ONCE):
            x = np.cos(float(key)) * sines[at : at + AT_ONCE] + np.sin(float(key)) * cosines[at : at + AT_ONCE]
            w.writeframes((x / 3 * 32000).astype("<i2").tobytes())
    return out.getvalue()


def wave_files(spark: SparkSession, sf_dir: str, folder: str, seconds: int = 10, rate: int = 44100, share: int = 0, shares: int = 1) -> int:
    """A wave file in folder for each supplier whose key leaves share when divided by shares."""

    def named(b: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        for key in b["s_suppkey"]:
            yield f"{key}.wav", tone(int(key), seconds, rate)

    keys = table(spark, sf_dir, "supplier").select("s_suppkey").where(F.pmod("s_suppkey", F.lit(shares)) == share)
    pitch = F.pmod("s_suppkey", F.lit(36))
    dealt = keys.repartitionByRange(max(8, spark.sparkContext.defaultParallelism), pitch, "s_suppkey")  # a task makes few pitches
    return write_files(dealt.sortWithinPartitions(pitch), folder, named)


def by_lots(spark: SparkSession, sf_dir: str, folder: str, query: Callable[[str], DataFrame], seconds: int = 10, rate: int = 44100) -> DataFrame:
    """What query gives for folders of wave files, over all suppliers' files.

    The files are some hundred times the suppliers' table, so they lie in the shared folder in lots, by the key's remainder:
    when a lot's rows are written its files go.
    """
    a_lot = max(1, min(LOT_FILES, LOT_BYTES // (2 * seconds * rate)))
    lots = max(1, -(-table(spark, sf_dir, "supplier").count() // a_lot))
    for k in range(lots):
        created(f"{folder}/audio")
        wave_files(spark, sf_dir, f"{folder}/audio", seconds, rate, k, lots)
        query(f"{folder}/audio").write.mode("append").parquet(f"{folder}/rows")
        removed(f"{folder}/audio")
    return spark.read.parquet(f"{folder}/rows")
