"""Table shapes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

TRACKS = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("fname", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("artist", T.StringType()), T.StructField("album", T.StringType()), T.StructField("track", T.IntegerType()),
    T.StructField("length", T.IntegerType()), T.StructField("exclude", T.BooleanType()),
    T.StructField("spect_hist", T.ArrayType(T.ArrayType(T.FloatType()))),
])
PCM = "stream_id long, chunk_no int, frate int, samples array<float>"
FRAMES = "track_id long, frame_no int, bands array<double>"
