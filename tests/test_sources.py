import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.config import EngineConfig
from bandwright.sources import files


def test_suffix(spark):
    paths = ["a.MP3", "a.mp", "a.mp3x", "mp3"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(files.has_extension(F.col("path"), ["mp3"])).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(files.has_extension(F.col("path"), ["mp3"], prefix=True)).collect()] == [True] * 4


def test_stem_and_tags(spark):
    df = spark.createDataFrame([("/x/y.z.mp3", ""), ("/x/plain", None), ("/x/k.ogg", "T")], "fname string, title string")
    assert [r["title"] for r in files.tags(df).collect()] == ["y.z", "plain", "T"]


@pytest.mark.parametrize("kind", list(files.ENCODINGS))
def test_pcm(kind):
    dtype, silence, most = files.ENCODINGS[kind]
    raw = np.array([silence, silence, silence + most / 2, silence], dtype)
    assert files.mono(raw.tobytes() + b"\0", kind, 2) == pytest.approx([0.0, 0.25])
    assert files.mono(raw.tobytes(), kind, 2, "sum") == pytest.approx([0.0, 0.5])


def test_decode_files(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(np.arange(20_000, dtype="<f4").tobytes())
    df = files.decode_pcm(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [len(r["samples"]) for r in df.orderBy("chunk_no").collect()] == [16384, 3616]
    assert files.listing(spark, str(tmp_path), ["raw"]).count() == 1


def test_legacy_round_trip(spark, tmp_path):
    config = EngineConfig(bands=2, bins=4)
    rows = [("/m/" + "ü" * 200, "t", "a", None, 3, 61, np.full((2, 4), 0.25)), ("/b", "", "", "", 0, 0, np.zeros((2, 4)))]
    (tmp_path / "x.hdb").write_bytes(files.legacy_bytes(rows, config))
    back = files.read_legacy(spark, str(tmp_path / "x.hdb"), config).orderBy("track").collect()
    assert [r["fname"] for r in back] == ["/b", "/m/" + "ü" * 126] and back[1]["length"] == 61 and back[1]["spect_hist"] == [[0.25] * 4] * 2 and not back[0]["exclude"]
    with pytest.raises(ValueError):
        list(files.legacy_rows((tmp_path / "x.hdb").read_bytes(), EngineConfig(bands=2, bins=5)))


def test_registry_of_decoders():
    files.register("raw", lambda b: (1, np.zeros(1)))
    files.register("pcm", lambda b: (1, np.zeros(1)))
    assert files.supported(1) == ["pcm"] and "raw" in files.supported()
