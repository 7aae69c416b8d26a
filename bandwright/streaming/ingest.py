"""Continuous ingest: a stream of the files that come into a folder, into a track table that every restart finds whole.

    query = ingest.follow(spark, "s3://music", "s3://db", CONFIG, ["wav"])

A micro-batch writes one folder, files/epoch=<name>/batch=<id>, which a repeated batch overwrites, so a batch counts once
however often it is tried. The epoch's name lies with the stream's state; a stream that has lost it begins another. Its rows are all files that it has tried: with a histogram, or with an error. Files of the table are not decoded
again; those with errors are tried again with every batch, MOST_TRIES times at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandwright.config import DEFAULT, EngineConfig
from bandwright.operators import ingest
from bandwright.operators.features import tracks_of
from bandwright.sources import tables
from bandwright.sources.datasource import opened
from bandwright.sources.files import has_extension

PARTS = "epoch string, batch long"
ROW = "fname string, length int, frames long, spect_hist array<array<double>>, error string, tries int"
FILES = "path string, modificationTime timestamp, length long, content binary"
MOST_TRIES = 5
#: Tasks that a batch's files are looked up in: Spark's own setting gives each file a task, whose result goes to the driver.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 32


def prepared(spark: SparkSession, db: str, config: EngineConfig) -> None:
    """Makes an empty table where there is none, and refuses one of another configuration."""
    spark.createDataFrame([], f"{ROW}, {PARTS}").write.mode("ignore").partitionBy("epoch", "batch").parquet(f"{db}/files")
    spark.createDataFrame([asdict(config)]).write.mode("ignore").parquet(f"{db}/config")
    tables.check(spark, db, config)


def epoch_of(db: str) -> str:
    """The name that lies with the stream's state, made where there is none."""
    where, inside = opened(f"{db}/stream/epoch")
    try:
        with where.open_input_file(inside) as found:
            return found.read().decode()
    except OSError:
        name = uuid.uuid4().hex
        where.create_dir(inside.rpartition("/")[0], recursive=True)
        with where.open_output_stream(inside) as out:
            out.write(name.encode())
        return name


def tried(spark: SparkSession, db: str) -> DataFrame:
    """(fname, length, frames, spect_hist, error, tries, epoch, batch) of all tries."""
    return spark.read.schema(f"{ROW}, {PARTS}").parquet(f"{db}/files")


def tracks(spark: SparkSession, db: str) -> DataFrame:
    """(fname, length, frames, spect_hist): the track table, a row for each file that has been decoded."""
    return tried(spark, db).where("error is null").select("fname", "length", "frames", "spect_hist")


def failed(spark: SparkSession, db: str) -> DataFrame:
    """(fname, tries, error) of files that have not been decoded yet, with the last try's error."""
    last = tried(spark, db).groupBy("fname").agg(F.max(F.struct("tries", "error")).alias("last"), F.max(F.col("error").isNull()).alias("done"))
    return last.where(~F.col("done")).select("fname", "last.tries", "last.error")


def read_again(paths: DataFrame) -> DataFrame:
    """(path, content) of (path); no content where a file is gone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                try:
                    where, inside = opened(path)
                    with where.open_input_file(inside) as stream:
                        content = stream.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": pd.Series([content], dtype=object)})

    return paths.mapInPandas(run, "path string, content binary")


def ingested(batch: DataFrame, epoch: str, number: int, db: str, config: EngineConfig = DEFAULT, most_tries: int = MOST_TRIES) -> None:
    """Decodes the new files of a batch (path, content), and those that failed before, into the batch's folder.

    Only paths are compared with the table; contents stay where they are read. A batch's paths, at most the stream's
    maxFilesPerTrigger, are broadcast to its own rows.
    """
    spark = batch.sparkSession
    before = tried(spark, db).where((F.col("epoch") != epoch) | (F.col("batch") != number))
    done = before.groupBy("fname").agg(F.max("tries").alias("tries"), F.max(F.col("error").isNull()).alias("done")).withColumnRenamed("fname", "path")
    new = ingest.missing(batch.select("path").distinct(), done, "path")
    again = done.where(~F.col("done") & (F.col("tries") < most_tries)).select("path", "tries")
    files = batch.join(F.broadcast(new), "path", "left_semi").select("path", "content").unionByName(read_again(again.select("path")))
    rows = tracks_of(files, config).join(F.broadcast(again.withColumnRenamed("path", "fname")), "fname", "left")
    rows.withColumn("tries", F.coalesce("tries", F.lit(0)) + 1).select("fname", "length", "frames", "spect_hist", "error", "tries").write.mode("overwrite").parquet(f"{db}/files/epoch={epoch}/batch={number}")


def listing_session(spark: SparkSession) -> SparkSession:
    """A session of the same settings that looks files up in few tasks."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(LISTING, str(min(int(spark.conf.get(LISTING)), LISTING_TASKS)))
    return own


def follow(spark: SparkSession, folder: str, db: str, config: EngineConfig = DEFAULT, extensions: list[str] | None = None, files_a_batch: int = 10_000, most_tries: int = MOST_TRIES, **trigger) -> StreamingQuery:
    """Starts the stream; trigger as of DataStreamWriter.trigger, by default all files that are there now. State and table lie in db."""
    prepared(spark, db, config)
    epoch = epoch_of(db)
    source = listing_session(spark).readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    if extensions:
        source = source.where(has_extension(F.col("path"), extensions))
    writer = source.writeStream.option("checkpointLocation", f"{db}/stream").trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: ingested(batch, epoch, number, db, config, most_tries)).start()
