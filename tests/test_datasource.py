import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.config import EngineConfig
from bandwright.sources import datasource, files


@pytest.fixture
def audio(spark, tmp_path):
    datasource.register(spark)
    rng = np.random.default_rng(3)
    for name, frames, channels in (("a/one.wav", 50_000, 1), ("a/two.WAV", 4_096, 2), ("b/three.wav", 0, 1), ("b/long.wav", 200_000, 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes(rng.integers(-3000, 3000, frames * channels, dtype="<i2").tobytes())
    (tmp_path / "b" / "bad.wav").write_bytes(b"RIFF nothing")
    (tmp_path / "b" / "none.txt").write_text("x")
    return tmp_path


@pytest.mark.parametrize("size", [1 << 25, 20_000])
def test_chunks_equal_decoding(spark, audio, size):
    found = spark.read.format("bandwright.audio").option("chunk", 4096).option("partitionBytes", size).load(str(audio))
    rows = found.orderBy("path", "chunk_no").collect()
    assert found.rdd.getNumPartitions() == (1 if size > 1 << 20 else 6 + 21 + 1)
    by_path = {}
    for r in rows:
        by_path.setdefault(os.path.relpath(r["path"].removeprefix("file://"), audio), []).append(r)
    assert set(by_path) == {"a/one.wav", "a/two.WAV", "b/long.wav", "b/bad.wav"}
    assert [r["error"] is not None for r in by_path["b/bad.wav"]] == [True] and by_path["b/bad.wav"][0]["samples"] is None
    for name in ("a/one.wav", "a/two.WAV", "b/long.wav"):
        rate, x = files.decode_wav((audio / name).read_bytes())
        assert [r["chunk_no"] for r in by_path[name]] == list(range(-(-len(x) // 4096))) and {r["frate"] for r in by_path[name]} == {rate}
        assert np.concatenate([r["samples"] for r in by_path[name]]).tolist() == x.astype(np.float32).tolist()


def test_path_filters_reach_the_listing(spark, audio):
    reader = datasource.AudioReader({"path": str(audio)}, dict(files.DECODERS))
    other = datasource.EqualTo(("frate",), 8000)
    assert list(reader.pushFilters([datasource.StringContains(("path",), "/a/"), other])) == [other]
    assert [os.path.basename(s[0]) for p in reader.partitions() for s in p.shares] == ["one.wav", "two.WAV"]
    found = spark.read.format("bandwright.audio").load(str(audio))
    assert {r[0].rpartition("/")[2] for r in found.where(F.col("path").endswith("one.wav")).select("path").distinct().collect()} == {"one.wav"}
    assert found.where("path = 'none'").count() == 0 and spark.read.format("bandwright.audio").load(str(audio / "a" / "one.wav")).count() == 4


def test_registered_decoders_are_read(spark, tmp_path):
    files.register("raw8", lambda data: (100, __import__("numpy").frombuffer(data, "u1") / 255))
    datasource.register(spark)
    (tmp_path / "x.raw8").write_bytes(bytes([0, 255, 51]))
    rows = spark.read.format("bandwright.audio").option("extensions", "raw8").load(str(tmp_path)).collect()
    assert [(r["chunk_no"], r["frate"], [round(x, 3) for x in r["samples"]]) for r in rows] == [(0, 100, [0.0, 1.0, 0.2])]


CONFIG = EngineConfig(bands=2, bins=4)


def track_rows(spark, n, hist=None):
    return spark.createDataFrame([(f"/m/{i}", f"t{i}", "a", None, i, 60 + i, hist or [[0.25] * 4, [0.1, 0.2, 0.3, 0.4]]) for i in range(n)], datasource.TRACKS)


def test_track_files(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "db")
    save = lambda df, mode: df.write.format("bandwright.tracks").options(**datasource.options_of(CONFIG)).option("rows", 3).mode(mode).save(out)
    save(track_rows(spark, 10).repartition(2), "overwrite")
    names = os.listdir(out)
    assert "_SUCCESS" in names and not any(n.startswith("_staging") for n in names) and 4 <= len(names) - 1 <= 5
    back = files.read_legacy(spark, f"{out}/*.hdb", CONFIG).orderBy("track").collect()
    assert [(r["fname"], r["title"], r["length"]) for r in back] == [(f"/m/{i}", f"t{i}", 60 + i) for i in range(10)] and back[3]["spect_hist"][0] == [0.25] * 4
    save(track_rows(spark, 2), "append")
    assert files.read_legacy(spark, f"{out}/*.hdb", CONFIG).count() == 12
    save(track_rows(spark, 1), "overwrite")
    assert files.read_legacy(spark, f"{out}/*.hdb", CONFIG).count() == 1


def test_failed_task_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "db")
    good, bad = track_rows(spark, 6).repartition(3), track_rows(spark, 1, [[1.0]])
    save = lambda df: df.write.format("bandwright.tracks").options(**datasource.options_of(CONFIG)).mode("overwrite").save(out)
    save(good)
    before = sorted(os.listdir(out))
    with pytest.raises(Exception, match="does not fit"):
        save(good.unionByName(bad))
    assert sorted(os.listdir(out)) == before and files.read_legacy(spark, f"{out}/*.hdb", CONFIG).count() == 6


@pytest.mark.parametrize(("colored", "inverted"), [(False, False), (False, True), (True, False), (True, True)])
def test_raster_files(spark, tmp_path, colored, inverted):
    datasource.register(spark)
    values = [[0.0, 1.0, 0.5], [0.25, 2.0, -1.0]]
    images = spark.createDataFrame([("x", values), ("y", [[0.1]])], datasource.RASTER)
    images.write.format("bandwright.raster").options(colored=str(colored).lower(), inverted=str(inverted).lower()).mode("overwrite").save(str(tmp_path / "img"))
    most = 0xFFFFFF if colored else 0xFF
    body = b"".join(bytes(255 - b if inverted else b for b in int(min(max(v, 0), 1) * most).to_bytes(4, "little")[: 3 if colored else 1]) for row in values for v in row)
    head = (b"P6" if colored else b"P5") + b"\n3 2\n255\n"
    kind = "ppm" if colored else "pgm"
    assert (tmp_path / "img" / f"x.{kind}").read_bytes() == head + body and sorted(os.listdir(tmp_path / "img")) == ["_SUCCESS", f"x.{kind}", f"y.{kind}"]
    with pytest.raises(Exception, match="one name"):
        images.unionByName(images).write.format("bandwright.raster").options(colored=str(colored).lower()).mode("append").save(str(tmp_path / "img"))
    assert sorted(os.listdir(tmp_path / "img")) == ["_SUCCESS", f"x.{kind}", f"y.{kind}"]
