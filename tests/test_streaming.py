import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest

from bandwright.streaming import framing, radio

SCHEMA = "track_id long, ts timestamp, event_id long, value double"


@pytest.mark.parametrize("cut", [(40,), (3, 20, 40), (16, 17, 40)])
def test_frames_do_not_depend_on_chunks(spark, tmp_path, cut):
    rows = [(1, datetime(2024, 1, 1) + timedelta(seconds=i), i, float(i)) for i in range(40)]
    first = 0
    for k, stop in enumerate(cut):
        spark.createDataFrame(rows[first:stop], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        first = stop
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = framing.drained(framing.hop_frames(stream, 16, 8), f"t-{uuid.uuid4().hex}")
    assert [(r["frame_no"], r["total"]) for r in out.orderBy("frame_no").collect()] == [(f, float(sum(range(f * 8, f * 8 + 16)))) for f in range(3)]


def test_session_batch():
    events = pd.DataFrame({"ts": [1, 2, 3], "event_id": [1, 2, 3], "kind": ["next", "like", "play"], "track_id": [7, 7, 8]})
    out = radio.advance(radio.Session(), 5, events)
    assert out["likes"].tolist() == [[], [7], [7]] and out["recents"].tolist() == [[7], [], []] and out["n_excluded"].tolist() == [1, 1, 2]
