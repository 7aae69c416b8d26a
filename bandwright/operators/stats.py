"""Frame statistics: band ranges, self-similarity, smoothing, scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.functions.arrays import bin_of, fixed, total

RANGES, RANGE_WIDTH = 14, 0.25
#: Frames of a block of the self-similarity.
BLOCK_ROWS = 512


def band_stats(frames: DataFrame) -> DataFrame:
    """(band, low, high, pct_0 .. pct_13): least and largest value (at least 0), percent of frames in ranges of 0.25; the last is open, negatives fall into the first."""
    each = frames.select(F.posexplode("bands").alias("band", "v"))
    place = F.least(F.greatest(F.floor(F.col("v") / RANGE_WIDTH), F.lit(0)), F.lit(RANGES - 1))
    shares = [(100.0 * F.count(F.when(place == r, 1)) / F.count("*")).alias(f"pct_{r}") for r in range(RANGES)]
    return each.groupBy("band").agg(F.min("v").alias("low"), F.greatest(F.max("v"), F.lit(0.0)).alias("high"), *shares)


def stats_report(stats: DataFrame) -> DataFrame:
    shares = F.concat_ws(" ", *(fixed(F.col(f"pct_{r}"), 2) for r in range(RANGES)))
    return stats.select("band", F.concat_ws(" ", fixed(F.col("low"), 4), fixed(F.col("high"), 4), shares).alias("line"))


def self_similarity(frames: DataFrame) -> DataFrame:
    """(track_id, i, j, dist): Euclidean distance of every two frames of a track, which is what the operator returns."""
    a = frames.select("track_id", F.col("frame_no").alias("i"), F.col("bands").alias("a"))
    b = frames.select("track_id", F.col("frame_no").alias("j"), F.col("bands").alias("b"))
    d = F.sqrt(total(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))))
    return a.join(b, "track_id").select("track_id", "i", "j", d.alias("dist"))


def row_means(matrix: DataFrame) -> DataFrame:
    """(track_id, i, mean): by symmetry the column mean too."""
    return matrix.groupBy("track_id", "i").agg(F.avg("dist").alias("mean"))


def self_means(frames: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(track_id, i, mean): row_means() of self_similarity() without its n x n rows.

    A track's frames stand in blocks of some hundred; every two blocks meet once, by an equi-join on the pair, and give their
    frames' sums of distances both ways. So a long track is spread over tasks.
    """
    w = W.partitionBy("track_id")
    placed = frames.select("track_id", F.col("frame_no").alias("i"), "bands", F.floor((F.row_number().over(w.orderBy("frame_no")) - 1) / rows).alias("own"), F.count("*").over(w).alias("n"))
    blocks = placed.groupBy("track_id", "own", "n").agg(F.array_sort(F.collect_list(F.struct("i", "bands"))).alias("s"))
    blocks = blocks.select("track_id", "own", "n", F.transform("s", lambda x: x["i"]).alias("i"), F.flatten(F.transform("s", lambda x: x["bands"])).alias("cells"))
    last = F.floor((F.col("n") - 1) / rows)
    left = blocks.select("track_id", "n", F.col("i").alias("i_a"), F.col("cells").alias("a"), F.col("own").alias("bi"), F.explode(F.sequence(F.col("own"), last)).alias("bj"))
    right = blocks.select("track_id", F.col("i").alias("i_b"), F.col("cells").alias("b"), F.col("own").alias("bj"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("bi"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for r in f.itertuples(index=False):
                a, b = r.a.reshape(len(r.i_a), -1), r.b.reshape(len(r.i_b), -1)
                squares = np.zeros((len(a), len(b)))
                for k in range(a.shape[1]):
                    squares += (a[:, k, None] - b[:, k]) ** 2
                d = np.sqrt(squares)
                out.append((r.track_id, r.n, r.i_a, d.sum(axis=1)))
                if r.bi != r.bj:
                    out.append((r.track_id, r.n, r.i_b, d.sum(axis=0)))
            yield pd.DataFrame(out, columns=["track_id", "n", "i", "sum"])

    sums = left.join(right, ["track_id", "bi", "bj"]).mapInPandas(run, "track_id long, n long, i array<int>, sum array<double>")
    each = sums.select("track_id", "n", F.explode(F.arrays_zip("i", "sum")).alias("x")).select("track_id", "n", "x.i", "x.sum")
    return each.groupBy("track_id", "i").agg((F.sum("sum") / F.first("n")).alias("mean"))


def smoothed(means: DataFrame, share: int = 100, width: int | None = None) -> DataFrame:
    """(track_id, i, smooth): forward moving average over max(1, n / share) rows, or width rows, cut at the end."""
    w = W.partitionBy("track_id").orderBy("i")
    if width is not None:
        return means.select("track_id", "i", F.avg("mean").over(w.rowsBetween(0, width - 1)).alias("smooth"))
    # Sums up to each row; a part's sum is that at its last row less that before its first.
    every = W.partitionBy("track_id")
    rows = means.select("track_id", "i", "mean", F.row_number().over(w).alias("k"), F.sum("mean").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("sum"), F.count("*").over(every).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / share))
    first = rows.withColumn("last", F.least(F.col("k") + size - 1, F.col("n")).cast("int"))
    last = rows.select("track_id", F.col("k").alias("last"), F.col("sum").alias("sum_last"))
    return first.join(last, ["track_id", "last"]).select("track_id", "i", ((F.col("sum_last") - F.col("sum") + F.col("mean")) / (F.col("last") - F.col("k") + 1)).alias("smooth"))


def dramatisation(smooth: DataFrame) -> DataFrame:
    """(track_id, score): upper median of the smoothed row means."""
    ranked = smooth.select("track_id", "smooth", F.row_number().over(W.partitionBy("track_id").orderBy("smooth")).alias("k"), F.count("*").over(W.partitionBy("track_id")).alias("n"))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("track_id", F.col("smooth").alias("score"))


def value_histogram(rows: DataFrame, value: Column, bins: int = 128) -> DataFrame:
    """(bin, count) of values on [0, 1]; values above fall into the last bin."""
    return rows.select(bin_of(value, bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))


def min_max_scaled(cells: DataFrame, by: list[str], to: float = 1.0) -> DataFrame:
    """Adds scaled: value between the least and the largest (at least 0) of its group, spread to [0, to]; constant groups stay."""
    w = W.partitionBy(*by)
    low, high = F.min("value").over(w), F.greatest(F.lit(0.0), F.max("value").over(w))
    return cells.withColumn("scaled", F.when(high == low, F.col("value")).otherwise((F.col("value") - low) / (high - low) * to))


def clip_limits(cells: DataFrame, steps: int = 100, share: float = 0.95) -> DataFrame:
    """One row (low, high): of steps + 1 even thresholds between the least value and the largest, the first going down that has more than share of the values above it, and the first going up that has more than share below it."""
    ends = cells.agg(F.min("value").alias("least"), F.greatest(F.lit(0.0), F.max("value")).alias("most"), F.count("*").alias("n"))
    thresholds = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("s")).withColumn("t", F.col("least") + (F.col("most") - F.col("least")) * F.col("s") / steps)
    # A value's place among the thresholds is arithmetic; counts by place replace a comparison of all values with all thresholds.
    met = cells.join(F.broadcast(ends))
    span = F.col("most") - F.col("least")
    guess = F.when(span == 0, F.lit(0)).otherwise(F.floor((F.col("value") - F.col("least")) / span * steps))
    at = lambda s: F.col("least") + span * s / steps
    below = F.when(span == 0, F.lit(0)).when(at(guess + 1) < F.col("value"), guess + 2).when(at(guess) < F.col("value"), guess + 1).when(at(guess - 1) < F.col("value"), guess).otherwise(guess - 1)
    up_to = F.when(span == 0, F.lit(steps + 1)).when(at(guess + 1) <= F.col("value"), guess + 2).when(at(guess) <= F.col("value"), guess + 1).when(at(guess - 1) <= F.col("value"), guess).otherwise(guess - 1)
    above = met.groupBy(below.alias("s")).agg(F.count("*").alias("c"))  # value exceeds the first s thresholds
    under = met.groupBy(up_to.alias("s")).agg(F.count("*").alias("c"))  # value is below all thresholds from s on
    all_above = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)  # at most steps + 1 rows
    all_under = W.orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    grid = thresholds.join(above.select((F.col("s") - 1).alias("s"), F.col("c").alias("c_above")).where("s >= 0"), "s", "left").join(under.withColumnRenamed("c", "c_under"), "s", "left").fillna(0, ["c_above", "c_under"])
    counts = grid.select("t", "n", F.sum("c_above").over(all_above).alias("above"), F.sum("c_under").over(all_under).alias("under"))
    return counts.agg(F.max(F.when(F.col("above") > share * F.col("n"), F.col("t"))).alias("low"), F.min(F.when(F.col("under") > share * F.col("n"), F.col("t"))).alias("high"))


def globally_scaled(cells: DataFrame, to: float = 1.0) -> DataFrame:
    """Adds scaled: value between the clip limits, spread to [0, to] and clamped; what is not finite is 0."""
    met = cells.join(F.broadcast(clip_limits(cells)))
    unit = (F.col("value") - F.coalesce("low", F.lit(0.0))) / F.nullif(F.col("high") - F.coalesce("low", F.lit(0.0)), F.lit(0.0)) * to
    return met.withColumn("scaled", clamped(unit, to)).drop("low", "high")


def clamped(value: Column, to: float = 1.0) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.least(F.greatest(value, F.lit(0.0)), F.lit(to))).otherwise(0.0)
