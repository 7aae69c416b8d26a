import wave

import numpy as np
import pytest

from bandwright.config import EngineConfig
from bandwright.operators import features, frames, signal
from bandwright.sources import tables

CONFIG = EngineConfig(bands=4, bins=8, window=64, step=32, min_frames=3)


def sine(path, seconds):
    x = (np.sin(np.arange(int(8000 * seconds)) / 5) * 20000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(x.tobytes())
    return x / 32768


def test_files_to_tracks(spark, tmp_path):
    x = sine(tmp_path / "a.wav", 0.1)
    sine(tmp_path / "short.wav", 0.01)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_text("no audio")
    out = {r["fname"].rpartition("/")[2]: r for r in features.tracks_of(spark.read.format("binaryFile").load(str(tmp_path)), CONFIG).collect()}
    assert out["short.wav"]["error"] == "too short" and out["bad.wav"]["spect_hist"] is None and "KeyError" in out["c.txt"]["error"]
    assert [sum(b) for b in out["a.wav"]["spect_hist"]] == pytest.approx([1.0] * 4)
    stream = spark.createDataFrame([(1, i, i, float(v)) for i, v in enumerate(x)], "track_id long, ts long, event_id long, value double")
    plain = frames.band_power(frames.dft_power(stream, 64, 32), 64, 8000, 4)
    expected = {(r["frame_no"], r["band"]): r["value"] for r in plain.collect()}
    found = np.concatenate(list(features.band_frames(x, 8000, CONFIG)))
    assert len(found) * 4 == len(expected) and all(found[f, b] == pytest.approx(v, abs=1e-9) for (f, b), v in expected.items())


def test_table_keeps_its_configuration(spark, tmp_path):
    rows = spark.createDataFrame([(1, True)], "track_id long, exclude boolean")
    tables.write_tracks(rows, str(tmp_path / "db"), CONFIG)
    assert tables.append_tracks(rows, str(tmp_path / "db"), CONFIG) and not tables.append_tracks(rows.where("false"), str(tmp_path / "db"), CONFIG)
    back = tables.read_tracks(spark, str(tmp_path / "db"), CONFIG).collect()
    assert len(back) == 2 and not any(r["exclude"] for r in back)
    with pytest.raises(ValueError):
        tables.read_tracks(spark, str(tmp_path / "db"))


def test_notes_of_a_tone(spark, tmp_path):
    x = (sum(np.sin(2 * np.pi * 440 * k * np.arange(8000) / 8000) / k for k in (1, 2, 3)) * 10000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(x.tobytes())
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    sine(tmp_path / "short.wav", 0.01)
    config = EngineConfig(bands=0, window=512, step=256)
    assert config.bands == 257
    rows = features.note_frames(spark.read.format("binaryFile").load(str(tmp_path)), config).collect()
    good = [r for r in rows if r["error"] is None]
    assert [r["frame_no"] for r in good] == list(range(30)) and {r["fname"].rpartition("/")[2] for r in rows} == {"a.wav", "bad.wav"}
    values = np.concatenate(list(features.band_frames(x / 32768, 8000, config)))
    for r, v in zip(good, values, strict=True):
        products = [v[i] * (v[2 * i] if 2 * i < 257 else 0) * (v[3 * i] if 3 * i < 257 else 0) for i in range(257)]
        expected = {signal.note_of_bin(i, 512, 8000) for i in range(signal.first_note_bin(512, 8000), 257) if products[i] >= 0.75 * max(products)}
        assert {r["first_note"] + k for k, on in enumerate(r["active"]) if on} == expected
