"""Multi-seed nearest neighbours with a tie-aware top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.functions.arrays import fixed, rounded
from bandwright.functions.distances import DEFAULT, Distance, prepared

#: Seeds are a query's parameter; more than these are refused, as they are broadcast.
MAX_SEEDS = 10_000
DIGITS = 8


def seed_distances(tracks: DataFrame, seed_ids: list[int], distance: str | Distance = DEFAULT) -> DataFrame:
    """(seed_id, track_id, dist) of every seed to every track; the seed is the first argument. A repeated seed counts again.

    The few seeds are one broadcast side, so tracks are scanned once and not shuffled.
    """
    if len(seed_ids) > MAX_SEEDS:
        raise ValueError(f"at most {MAX_SEEDS} seeds")
    kept, function = prepared(F.col("hist"), distance)
    rows = tracks.select("track_id", kept.alias("kept"))
    places = F.transform(F.filter(F.transform(F.array(*map(F.lit, seed_ids)), lambda s, i: F.struct(s.alias("id"), i.alias("k"))), lambda s: s["id"] == F.col("track_id")), lambda s: s["k"])
    seeds = rows.where(F.col("track_id").isin(seed_ids)).select(F.col("track_id").alias("seed_id"), F.col("kept").alias("seed_kept"), F.explode(places).alias("seed_no"))
    return rows.join(F.broadcast(seeds)).select("seed_id", "seed_no", "track_id", function(F.col("seed_kept"), F.col("kept")).alias("dist"))


def combined(distances: DataFrame) -> DataFrame:
    """(track_id, distance): 1 / sum(1 / d) over the seeds whose d is not 0; 0 if there is none."""
    parts = F.sum(F.when(F.col("dist") != 0, 1 / F.col("dist")))
    return distances.groupBy("track_id").agg(F.coalesce(1 / parts, F.lit(0.0)).alias("distance"))


def top_distinct(scored: DataFrame, n: int) -> DataFrame:
    """(rank, track_id, distance): the n smallest distinct distances, each with its highest track_id. Too few give fewer rows."""
    best = scored.where(F.col("distance").isNotNull() & ~F.isnan("distance")).withColumn("distance", rounded(F.col("distance"), DIGITS))
    best = best.groupBy("distance").agg(F.max("track_id").alias("track_id")).orderBy("distance").limit(n)  # n rows from here on
    return best.select(F.row_number().over(W.orderBy("distance")).alias("rank"), "track_id", "distance")


def similar(tracks: DataFrame, seed_ids: list[int], n: int = 10, distance: str | Distance = DEFAULT) -> DataFrame:
    """The n tracks closest to all seeds together; seeds and excluded tracks are no candidates."""
    pool = tracks.where(~F.col("exclude") | F.col("track_id").isin(seed_ids))
    scored = combined(seed_distances(pool, seed_ids, distance))
    return top_distinct(scored.where(~F.col("track_id").isin(seed_ids)), n)


def report(answer: DataFrame, catalog: DataFrame) -> DataFrame:
    """(rank, line) with distance, title, artist and album in fixed widths."""
    line = F.format_string("%s\t%-40s%-30s%-30s", fixed(F.col("distance"), 6), "title", "artist", "album")
    return answer.join(catalog, "track_id").select("rank", line.alias("line"))
