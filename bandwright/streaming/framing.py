"""Hop framing and windows over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hop_frames(stream: DataFrame, window: int, step: int) -> DataFrame:
    """(track_id, frame_no, total) of count windows over a stream (track_id, ts, event_id, value); the unused tail is the state.

    Frame f is out as soon as a sample after its last one has come, so the result does not depend on how the stream was
    cut. Rows of a batch are sorted by (ts, event_id); rows older than the tail are too late and left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame_no, tail, last = state.get if state.exists else (0, [], (0, -1))
        new = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        places = list(zip(new["ts"].astype("int64"), new["event_id"], strict=True))
        fresh = [p > tuple(last) for p in places]
        tail = [*tail, *new["value"][fresh].tolist()]
        out, at = [], 0
        while len(tail) - at > window:
            out.append((key[0], frame_no, float(sum(tail[at : at + window]))))
            at, frame_no = at + step, frame_no + 1
        state.update((frame_no, tail[at:], max([tuple(last), *places[-1:]])))
        yield pd.DataFrame(out, columns=["track_id", "frame_no", "total"])

    return stream.groupBy("track_id").applyInPandasWithState(
        run, "track_id long, frame_no int, total double", "frame_no int, tail array<double>, last struct<ts:long,id:long>", "append", GroupStateTimeout.NoTimeout
    )


def hop_windows(stream: DataFrame, length: str, slide: str, late: str | None = None) -> DataFrame:
    """(start, kind, n, total) of event-time windows; with late as the watermark on a stream."""
    rows = stream.withWatermark("ts", late) if late else stream
    return rows.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("event_type").alias("kind"), "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a parquet table in the shared folder, and reads it.

    With mode complete each batch replaces the table, so windows that no watermark has closed are in it too.
    """
    from bandwright.sources.files import checkpoint_dir

    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":
        spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/data")
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/data")).start()
    else:
        query = writer.format("parquet").option("path", f"{folder}/data").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
