"""Incremental ingest of files into the track table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def missing(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of files whose key is not known; duplicates stay."""
    return files.join(known.select(key).distinct(), key, "left_anti")


def pruned(known: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Known rows whose file still exists."""
    return known.join(files.select(key).distinct(), key, "left_semi")


def appended(first: DataFrame, second: DataFrame, key: str = "track_id") -> DataFrame:
    """Both tables, duplicates kept; the second one's keys go on after the first one's."""
    after = first.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("base"))
    return first.unionByName(second.join(F.broadcast(after)).withColumn(key, F.col(key) + F.col("base")).drop("base"))


def load_once(paths: list[str]) -> list[str]:
    """Database paths in their order, each once, those with the database suffix."""
    return [p for p in dict.fromkeys(paths) if p.endswith(".hdb")]


def split(rows: DataFrame, parts: int, key: str = "track_id", ranges: int = 64) -> DataFrame:
    """Adds part: floor(n / parts) rows each in key order, the rest in the last; with n <= parts one row each.

    Rows are numbered range by range, on bounds from the key's quantiles, so no task sorts the whole table.
    """
    shares = [k / ranges for k in range(1, ranges)]
    bounds, n = rows.agg(F.percentile_approx(key, shares), F.count("*")).first()
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(key))) if bounds else F.lit(0)
    placed = rows.withColumn("cell", cell)
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size")).select("cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("cell").orderBy(key)) - 1 + F.col("base")
    return placed.join(F.broadcast(sizes), "cell").withColumn("part", F.least(F.floor(place / max(1, n // parts)), F.lit(parts - 1)).cast("int")).drop("cell", "base")


def write_if_any(new: DataFrame, path: str) -> bool:
    """Appends new rows; without any nothing is written."""
    if new.isEmpty():
        return False
    new.write.mode("append").parquet(path)
    return True


def progress(spark: SparkSession, job_group: str) -> dict[str, int]:
    """Tasks done and in all of the group's jobs, and the whole percent."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(job_group) for s in tracker.getJobInfo(j).stageIds]
    done, whole = sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)
    return {"done": done, "all": whole, "percent": 100 * done // whole if whole else 100}
