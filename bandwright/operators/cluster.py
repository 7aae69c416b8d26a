"""Clustering with exchangeable distance and centroid."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions import distances
from bandwright.functions.arrays import rounded
from bandwright.operators import aggregates

MAX_ROUNDS = 40
#: Centres that one broadcast row holds at most.
MAX_CENTRES = 10_000
#: Parts for each core that points are dealt to.
PARTS_A_CORE = 2


@dataclass(frozen=True)
class Strategy:
    """distance of two points and the centroid of a group, the latter from the mean of transformed cells and back."""

    distance: Callable[[Column, Column], Column]
    cell: Callable[[Column], Column]
    back: Callable[[Column], Column]


HELLINGER = Strategy(distances.total("hellinger"), F.sqrt, lambda m: m * m)
EUCLIDEAN = Strategy(distances.total("euclidean"), lambda x: x, lambda m: m)


def shared(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration in the checkpoint folder that all executors share."""
    from bandwright.sources.files import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sums(rows: DataFrame, strategy: Strategy = HELLINGER) -> DataFrame:
    """(cluster_id, band, bin, p, n, mark): a row for each task, cluster and shape of (track_id, hist, cluster_id), with the sums and numbers of its transformed cells.

    mark is the exclusive or of the rows' hashes: assignments whose marks differ are not the same.
    """
    cells = F.flatten(F.transform("hist", lambda h: F.coalesce(F.transform(h, lambda x: strategy.cell(x).cast("double")), F.array().cast("array<double>"))))
    shape = F.array_join(F.transform("hist", lambda h: F.coalesce(F.array_size(h), F.lit(0)).cast("string")), ",")
    source = rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.coalesce(shape, F.lit("")).alias("shape"), F.coalesce(cells, F.array().cast("array<double>")).alias("cells"), F.xxhash64("track_id", "cluster_id").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, str], list] = {}
        for b in batches:
            shapes = b.column(1).dictionary_encode()
            clusters, which, marks = b.column(0).to_numpy(), shapes.indices.to_numpy(), b.column(3).to_numpy()
            order = np.lexsort((which, clusters))
            turns = np.flatnonzero((np.diff(clusters[order]) != 0) | (np.diff(which[order]) != 0)) + 1
            for places in np.split(order, turns) if len(order) else []:
                key = int(clusters[places[0]]), shapes.dictionary[int(which[places[0]])].as_py()
                flat = b.column(2).take(pa.array(places)).flatten()
                there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(places), -1)
                values = np.where(there, flat.to_numpy(zero_copy_only=False).reshape(len(places), -1), 0.0)
                own = [values.sum(axis=0), there.sum(axis=0), np.bitwise_xor.reduce(marks[places])]
                before = states.get(key)
                states[key] = own if before is None else [before[0] + own[0], before[1] + own[1], before[2] ^ own[2]]
        for (cluster, text), (p, n, mark) in states.items():
            sizes = [int(x) for x in text.split(",") if x]
            band, place = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(0), *map(np.arange, sizes)])
            lists = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in ((band, pa.int32()), (place, pa.int32()), (p, pa.float64()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([cluster]), *lists, pa.array([int(mark)], pa.int64())], names=["cluster_id", "band", "bin", "p", "n", "mark"])

    return source.mapInArrow(run, "cluster_id long, band array<int>, bin array<int>, p array<double>, n array<long>, mark long")


def means(states: DataFrame, strategy: Strategy = HELLINGER) -> DataFrame:
    """(cluster_id, hist, mark): cell by cell the back-transformed mean of sums(), and a number that the assignment decides."""
    cells = states.select("cluster_id", "mark", F.explode(F.arrays_zip("band", "bin", "p", "n")).alias("c")).select("cluster_id", "mark", "c.*")
    found = cells.groupBy("cluster_id", "band", "bin").agg(strategy.back(F.sum("p") / F.nullif(F.sum("n"), F.lit(0))).alias("p"), F.bit_xor("mark").alias("mark"))
    bands = found.groupBy("cluster_id", "band").agg(F.array_sort(F.collect_list(F.struct("bin", "p"))).alias("h"), F.max("mark").alias("mark"))
    whole = bands.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("band", "h"))).alias("H"), F.max("mark").alias("mark"))
    return whole.select("cluster_id", F.transform("H", lambda b: F.transform(b["h"], lambda x: x["p"])).alias("hist"), "mark")


def centroids(points: DataFrame, assigned: DataFrame, strategy: Strategy = HELLINGER) -> DataFrame:
    """(cluster_id, hist): cell by cell the back-transformed mean. Tasks sum their points' cells, and only the sums are shuffled."""
    kind = assigned.schema["cluster_id"].dataType
    return means(sums(points.join(assigned, "track_id"), strategy), strategy).drop("mark").withColumn("cluster_id", F.col("cluster_id").cast(kind))


def merged_centroids(points: DataFrame, assigned: DataFrame, aggregate: aggregates.Aggregate | None = None) -> DataFrame:
    """(cluster_id, hist): the centroid by any mergeable aggregate over a point's cells in a row. Points have bands of equal length."""
    rows = points.join(assigned, "track_id").withColumn("bins", F.size(F.col("hist")[0]))
    bins = rows.groupBy("cluster_id").agg(F.max("bins").alias("bins"))
    found = aggregates.merged(rows, F.col("cluster_id"), F.flatten("hist"), aggregate or aggregates.HellingerMean()).withColumnRenamed("key", "cluster_id")
    bands = F.transform(F.sequence(F.lit(0), (F.size("result") / F.col("bins")).cast("int") - 1), lambda b: F.slice("result", b * F.col("bins") + 1, F.col("bins")))
    return found.join(bins, "cluster_id").select("cluster_id", bands.alias("hist"))


def nearest(points: DataFrame, strategy: Strategy = HELLINGER, **centres: DataFrame) -> DataFrame:
    """(track_id, hist) and a column for each of centres (cluster_id, hist), few: the nearest by distance to 9 digits, the lowest cluster on ties."""
    out, kept = points.select("track_id", "hist"), ["track_id", "hist"]
    for name, each in centres.items():
        one = F.broadcast(each.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "hist"))).alias("centres")))
        near = lambda c: F.struct(rounded(strategy.distance(F.col("hist"), c["hist"]), 9).alias("d"), c["cluster_id"].alias("cluster_id"))
        out = out.join(one).select(*kept, F.array_min(F.transform("centres", near))["cluster_id"].alias(name))
        kept = [*kept, name]
    return out


def assign(points: DataFrame, centres: DataFrame, strategy: Strategy = HELLINGER) -> DataFrame:
    """(track_id, cluster_id): nearest centre by distance to 9 digits, the lowest cluster on ties. centres: (cluster_id, hist), few."""
    if centres.count() > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    return nearest(points, strategy, cluster_id=centres).drop("hist")


def spread_seeds(points: DataFrame, k: int, strategy: Strategy = HELLINGER, first: int | None = None) -> DataFrame:
    """(cluster_id, track_id, hist): the first point (least id if not given), then each time the point with the least sum of 1 / d^2 over the chosen.

    Points that coincide with a chosen one are never picked; ties go to the lower id. Each point carries its sum, to which a
    round adds the distance to the newest seed alone; the sums lie in the checkpoint folder between rounds.
    """
    chosen = [points.agg(F.min("track_id")).first()[0] if first is None else first]
    carried = points.select("track_id", "hist", F.lit(0.0).alias("s"))
    for _ in range(1, k):
        newest = F.broadcast(points.where(F.col("track_id") == chosen[-1]).select(F.col("hist").alias("seed")).limit(1))
        d = strategy.distance(F.col("hist"), F.col("seed"))
        carried = shared(carried.join(newest).withColumn("d", d).where("d > 0").select("track_id", "hist", (F.col("s") + 1 / (F.col("d") * F.col("d"))).alias("s")))
        best = carried.orderBy(rounded(F.col("s"), 9), "track_id").select("track_id").first()
        if best is None:
            raise ValueError("fewer distinct points than clusters")
        chosen.append(best[0])
    order = F.create_map(*(F.lit(x) for i, t in enumerate(chosen) for x in (t, i)))
    return points.where(F.col("track_id").isin(chosen)).select(order[F.col("track_id")].alias("cluster_id"), "track_id", "hist")


def kmeans(points: DataFrame, k: int, strategy: Strategy = HELLINGER, rounds: int = MAX_ROUNDS) -> tuple[DataFrame, bool]:
    """((track_id, cluster_id), whether it converged): stops when no assignment changes. An empty cluster keeps its centre.

    Points are dealt to all cores once. A round is one pass over them, in which they are neither shuffled nor joined with their
    assignment: it leaves a few sums for each task, and each cluster's mark. Where these are as before, the assignments by both
    rounds' centres are compared.
    """
    if k >= points.count():
        raise ValueError("k must be smaller than the number of points")
    if k > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    spark = points.sparkSession
    points = shared(points.select("track_id", "hist").repartition(max(8, PARTS_A_CORE * spark.sparkContext.defaultParallelism)))
    seeds = spread_seeds(points, k, strategy).select("cluster_id", "hist")
    held, before, mark = dict(map(tuple, seeds.collect())), None, None
    for done in range(rounds + 1):
        centres = spark.createDataFrame(list(held.items()), seeds.schema)  # k rows, which each round broadcasts
        found = {x["cluster_id"]: x for x in means(sums(nearest(points, strategy, cluster_id=centres), strategy), strategy).collect()} if done < rounds or mark is not None else {}
        own = {c: x["mark"] for c, x in found.items()}
        still = own == mark and nearest(points, strategy, cluster_id=centres, old=before).where("cluster_id <> old").isEmpty()
        if still or done == rounds:
            return shared(assign(points, centres, strategy)), still
        before, mark = centres, own
        held |= {c: x["hist"] for c, x in found.items()}
