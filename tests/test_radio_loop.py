import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bandwright.operators import radio
from bandwright.streaming import framing
from bandwright.streaming import radio as stream

EVENTS = "session long, ts timestamp, event_id long, kind string, track_id long"


def some_events(n=120, sessions=4, kinds=("play", "click", "like", "dislike", "advance")):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        kind = rng.choice(kinds)
        rows.append((rng.randrange(sessions), datetime(2024, 1, 1) + timedelta(seconds=i // 2), i, kind, None if kind == "advance" else rng.randrange(14)))
    return rows


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(4)

    def band():
        raw = [rng.random() for _ in range(4)]
        return [x / sum(raw) for x in raw]

    rows = [(i, [band(), band()], i == 11) for i in range(12)]  # ids 12 and 13 are played but unknown
    rows[5] = (5, rows[4][1], False)  # equal histograms
    names = [(i, f"Title {i % 5}", "One" if i % 2 else "one") for i in range(10)]
    return spark.createDataFrame(rows, "track_id long, hist array<array<double>>, exclude boolean"), spark.createDataFrame(names, "track_id long, title string, artist string")


@pytest.mark.parametrize("distance", ["hellinger", "jensen"])
def test_loop_equals_one_session_after_another(spark, library, monkeypatch, distance):
    monkeypatch.setattr(radio, "TRACK_ROWS", 5)
    monkeypatch.setattr(radio, "SESSION_ROWS", 2)
    tracks, catalog = library
    rows = some_events(24, 3)
    expected = []
    for s in range(3):
        session, current, step = radio.Session(), None, 0
        for _, _, _, kind, track in [r for r in rows if r[0] == s]:
            if kind != "advance":
                session.apply(kind, track)
                current = track if kind in ("play", "click") else current
                continue
            found = radio.next_track(tracks, catalog, session, current, distance).first() if session.seeds() or current is not None else None
            if found:
                expected.append((s, step, found["track_id"], round(found["distance"], 6)))
                session.apply("next", found["track_id"])
                current = found["track_id"]
            step += 1
    found = radio.listened(spark.createDataFrame(rows, EVENTS), tracks, catalog, distance).withColumn("distance", F.round("distance", 6))
    assert expected and sorted(map(tuple, found.collect())) == sorted(expected)


def test_loop_ends_with_the_library(spark, library):
    tracks, catalog = library
    rows = [(1, datetime(2024, 1, 1), i, "advance" if i else "play", None if i else 0) for i in range(20)]
    found = radio.listened(spark.createDataFrame(rows, EVENTS), tracks, catalog).orderBy("step").collect()
    got = [r["track_id"] for r in found]
    assert len(set(got)) == len(got) and 11 not in got and 0 not in got and 5 <= len(got) <= 10
    none = spark.createDataFrame(rows[:1], EVENTS)
    assert radio.listened(none, tracks, catalog).count() == 0 and radio.listened(none.limit(0), tracks, catalog).count() == 0
    with pytest.raises(ValueError):
        radio.listened(none, tracks, catalog, "no such distance")


def test_session_stream_equals_batch(spark, tmp_path):
    rows = some_events(90, kinds=("play", "click", "like", "dislike", "next"))
    for k in range(3):  # three micro-batches
        spark.createDataFrame(rows[30 * k : 30 * (k + 1)], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = framing.drained(stream.session_stream(source), f"sessions-{uuid.uuid4().hex}")
    batch = stream.sessions(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect())) and out.count() == 90
