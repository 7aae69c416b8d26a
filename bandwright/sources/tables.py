"""The track table at rest: Parquet with the configuration it was made with."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.config import DEFAULT, EngineConfig


def write_tracks(tracks: DataFrame, path: str, config: EngineConfig = DEFAULT) -> None:
    """Overwrites path/tracks and path/config; exclude is stored as false."""
    tracks.withColumn("exclude", F.lit(False)).write.mode("overwrite").parquet(f"{path}/tracks")
    tracks.sparkSession.createDataFrame([asdict(config)]).write.mode("overwrite").parquet(f"{path}/config")


def append_tracks(tracks: DataFrame, path: str, config: EngineConfig = DEFAULT) -> bool:
    """Adds rows to a table of the same configuration; without new rows nothing is written."""
    check(tracks.sparkSession, path, config)
    if tracks.isEmpty():
        return False
    tracks.withColumn("exclude", F.lit(False)).write.mode("append").parquet(f"{path}/tracks")
    return True


def check(spark: SparkSession, path: str, config: EngineConfig) -> None:
    found = spark.read.parquet(f"{path}/config").first().asDict()
    if found != asdict(config):
        raise ValueError(f"the table was made with {found}")


def read_tracks(spark: SparkSession, path: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """The rows with exclude false; an error if the configuration differs."""
    check(spark, path, config)
    return spark.read.parquet(f"{path}/tracks").withColumn("exclude", F.lit(False))
