import os
import shutil
import wave

import numpy as np
import pytest

from bandwright.config import EngineConfig
from bandwright.operators import features
from bandwright.streaming import ingest

CONFIG = EngineConfig(bands=4, bins=8, window=64, step=32, min_frames=3)


def sine(path, pitch, seconds=0.1):
    path.parent.mkdir(parents=True, exist_ok=True)
    x = (np.sin(np.arange(int(8000 * seconds)) / pitch) * 20000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(x.tobytes())


def run(spark, folder, db, **options):
    ingest.follow(spark, str(folder), str(db), CONFIG, ["wav"], **options).awaitTermination()


def rows(df):
    return sorted((r["fname"].rpartition("/")[2], r["length"], r["frames"], str(r["spect_hist"])) for r in df.collect())


def test_batches_with_restarts_equal_one_run(spark, tmp_path):
    folder, db = tmp_path / "in", tmp_path / "db"
    for k in range(3):  # a restart between batches: each run goes on from the stream's state
        for i in range(3):
            sine(folder / f"{k}" / f"{k}{i}.wav", 3 + 3 * k + i)
        (folder / f"{k}" / "notes.txt").write_text("no audio")
        run(spark, folder, db)
        assert ingest.tracks(spark, str(db)).count() == 3 * (k + 1)
    run(spark, folder, db)
    one = features.tracks_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(str(folder)), CONFIG)
    assert rows(ingest.tracks(spark, str(db))) == rows(one.where("error is null")) and one.count() == 9
    assert sorted(p.name for p in (db / "files").glob("epoch=*/batch=*")) == ["batch=0", "batch=1", "batch=2"]
    with pytest.raises(ValueError):
        ingest.prepared(spark, str(db), EngineConfig(bands=5, bins=8, window=64, step=32, min_frames=3))


def test_repeated_batch_counts_once(spark, tmp_path):
    folder, db = tmp_path / "in", tmp_path / "db"
    for i in range(4):
        sine(folder / f"{i}.wav", 3 + i)
    run(spark, folder, db, files_a_batch=2)
    before = rows(ingest.tracks(spark, str(db)))
    os.remove(db / "stream" / "commits" / "1")  # the last batch ended, but the stream died before it noted so
    if (db / "stream" / "commits" / ".1.crc").exists():
        os.remove(db / "stream" / "commits" / ".1.crc")
    run(spark, folder, db, files_a_batch=2)
    assert rows(ingest.tracks(spark, str(db))) == before and len(before) == 4
    shutil.rmtree(db / "stream")  # even a stream that begins anew decodes nothing twice
    run(spark, folder, db)
    assert rows(ingest.tracks(spark, str(db))) == before and len(list((db / "files").glob("epoch=*"))) == 2


def test_failed_files_are_tried_again(spark, tmp_path):
    folder, db = tmp_path / "in", tmp_path / "db"
    sine(folder / "good.wav", 5)
    (folder / "late.wav").write_bytes(b"half a file")
    (folder / "bad.wav").write_bytes(b"never a file")
    run(spark, folder, db, most_tries=3)
    assert {r["fname"].rpartition("/")[2]: r["tries"] for r in ingest.failed(spark, str(db)).collect()} == {"late.wav": 1, "bad.wav": 1}
    sine(folder / "late.wav", 7)
    for k in range(4):
        sine(folder / f"next{k}.wav", 8 + k)
        run(spark, folder, db, most_tries=3)
    assert {r["fname"].rpartition("/")[2] for r in ingest.tracks(spark, str(db)).collect()} == {"good.wav", "late.wav", *(f"next{k}.wav" for k in range(4))}
    assert [(r["fname"].rpartition("/")[2], r["tries"]) for r in ingest.failed(spark, str(db)).collect()] == [("bad.wav", 3)]
    assert ingest.tracks(spark, str(db)).groupBy("fname").count().where("count > 1").count() == 0
