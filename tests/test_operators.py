import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.functions import distances
from bandwright.operators import catalog, cluster, frames, ingest, pairs, radio, signal, similarity, stats


def stream(spark, values, track=1):
    return spark.createDataFrame([(track, i, i, float(v)) for i, v in enumerate(values)], "track_id long, ts long, event_id long, value double")


@pytest.mark.parametrize(("n", "count"), [(40, 3), (17, 1), (16, 0), (5, 0)])
def test_framing(spark, n, count):
    rows = frames.framed(stream(spark, range(n)), 16, 8).groupBy("frame_no").agg(F.min("value"), F.max("value"), F.count("*")).orderBy("frame_no").collect()
    assert [tuple(r) for r in rows] == [(f, f * 8, f * 8 + 15, 16) for f in range(count)]


def test_spectrum_equals_numpy(spark):
    x = np.sin(np.arange(64)) * 3
    a = {(r["frame_no"], r["bin"]): r["power"] for r in frames.dft_power(stream(spark, x), 16, 8).collect()}
    b = {(r["frame_no"], r["bin"]): r["power"] for r in frames.rfft_power(stream(spark, x), 16, 8).collect()}
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(16) / 15))
    for f in range(6):
        expected = np.abs(np.fft.rfft(x[f * 8 : f * 8 + 16] * w)) ** 2
        for k in range(9):
            assert a[f, k] == pytest.approx(expected[k], abs=1e-8) and b[f, k] == pytest.approx(expected[k], abs=1e-8)


def test_histogram(spark):
    f = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [0.1, 0.9]), (1, 2, [0.2, 5.0])], "track_id long, frame_no int, bands array<double>")
    for bins in (4, 64):
        rows = frames.histograms(f, bins).collect()
        assert len(rows) == 2 * bins and sum(r["p"] for r in rows) == pytest.approx(2)
    assert len(frames.nested(frames.histograms(f, 4)).first()["hist"]) == 2
    assert frames.enough(f, 3).count() == 0 and frames.enough(f, 2).count() == 1


def test_seed_combination_and_top(spark):
    d = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.0), (2, 0.5), (3, 1.0), (3, 1.0), (4, 0.0), (4, 0.0)], "track_id long, dist double")
    assert {r[0]: r[1] for r in similarity.combined(d).collect()} == pytest.approx({1: 1 / 6, 2: 0.5, 3: 0.5, 4: 0.0})
    scored = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, float("nan"))], "track_id long, distance double")
    assert [tuple(r) for r in similarity.top_distinct(scored, 2).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 3, 2.0)]
    assert similarity.top_distinct(scored, 5).count() == 3


def points(spark):
    xy = [(0, 0), (0.5, 0.5), (5, 0), (5.5, 0), (0, 5), (0, 5.5), (5, 5), (5.5, 5.5)]
    return spark.createDataFrame([(i, [[float(x), float(y)]], False) for i, (x, y) in enumerate(xy)], "track_id long, hist array<array<double>>, exclude boolean")


def test_similar_excludes(spark):
    p = points(spark).withColumn("exclude", F.col("track_id") == 1)
    assert similarity.similar(p, [0], 1, "euclidean").first()["track_id"] == 4
    with pytest.raises(ValueError):
        similarity.similar(p, list(range(20_000)), 1)


def test_pairs(spark):
    t = pairs.triangle(points(spark), "euclidean", blocks=3)
    assert t.count() == 28 and pairs.mirrored(t, points(spark)).count() == 64
    assert pairs.ordered(t).first()["dist"] == pytest.approx(0.5)
    assert pairs.printed(t).count() == 7
    plain = pairs.triangle(points(spark), distances.euclidean, blocks=3)
    assert {(r["i"], r["j"], round(r["dist"], 9)) for r in plain.collect()} == {(r["i"], r["j"], round(r["dist"], 9)) for r in t.collect()}


@pytest.mark.parametrize("name", list(distances.REGISTRY))
def test_kernels_equal_expressions(spark, name):
    rng = np.random.default_rng(2)
    h = rng.random((9, 2, 5)) ** 4
    h /= h.sum(-1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "track_id long, hist array<array<double>>")
    found = {(r["i"], r["j"]): r["dist"] for r in pairs.triangle(df, name).collect()}
    a, b = (df.select(F.col("track_id").alias(k), F.col("hist").alias("h" + k)) for k in "ij")
    rows = a.join(b, F.col("i") > F.col("j")).select("i", "j", distances.total(name)(F.col("hi"), F.col("hj")).alias("d")).collect()
    assert len(found) == 36 and all(found[r["i"], r["j"]] == pytest.approx(r["d"], abs=1e-9) for r in rows)


def test_kmeans_fixture(spark):
    p = points(spark)
    seeds = {r["cluster_id"]: r["track_id"] for r in cluster.spread_seeds(p, 4, cluster.EUCLIDEAN).collect()}
    assert seeds == {0: 0, 1: 7, 2: 3, 3: 5}
    assigned, converged = cluster.kmeans(p, 4, cluster.EUCLIDEAN)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["track_id"])
    assert converged and sorted(map(sorted, groups.values())) == [[0, 1], [2, 3], [4, 5], [6, 7]]
    with pytest.raises(ValueError):
        cluster.kmeans(p, 8)


def test_moving_average_and_median(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 3, 2, 4, 0, 5, 6, 7])], "track_id long, i int, mean double")
    assert [round(r["smooth"], 4) for r in stats.smoothed(rows, width=3).orderBy("i").collect()] == [2, 3, 2, 3, 3.6667, 6, 6.5, 7]
    four = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "track_id long, smooth double")
    assert stats.dramatisation(four).first()["score"] == 3


def test_clip_limits_equal_scan(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=200).tolist(), [1.0, 1.0, 2.0], [3.0]):
        low, most = min(values), max(0.0, *values)
        grid = [low + (most - low) * s / 100 for s in range(101)]
        n = len(values)
        expected = (max((t for t in grid if sum(v > t for v in values) > 0.95 * n), default=None), min((t for t in grid if sum(v < t for v in values) > 0.95 * n), default=None))
        found = stats.clip_limits(spark.createDataFrame([(v,) for v in values], "value double")).first()
        assert tuple(found) == pytest.approx(expected) if None not in expected else tuple(found) == expected


def test_wavelet(spark):
    v = [float(x) for x in range(8)]
    df = spark.createDataFrame([(1, v), (2, [1.0, 2.0, 3.0]), (3, [])], "track_id long, v array<double>")
    forward = {r[0]: r[1] for r in signal.wavelet(df, "v").collect()}
    assert forward[1] == pytest.approx([3.9019, 10.0981, 0.3660, -3.8301, 0, 0, 0, -2.8284], abs=1e-4) and forward[2] == [1.0, 2.0] and forward[3] == []
    back = signal.wavelet(signal.wavelet(df, "v"), "v", inverse=True).where("track_id = 1").first()[1]
    assert back == pytest.approx(v)
    assert df.where("track_id = 1").select(signal.inverse_level(signal.level(F.col("v"))).alias("x")).first()[0] == pytest.approx(v)


def test_catalog(spark):
    rows = [(1, "/a/b.mp3", "", "X", "Y", 3), (2, "/c.ogg", "Song", "Band", "Disc", 12), (3, "/d", "Lone", None, "", 1)]
    c = spark.createDataFrame(rows, "track_id long, fname string, title string, artist string, album string, track int")
    assert [r[0] for r in c.select(catalog.display_title()).collect()] == ["/a/b.mp3", "12 - Song", "Lone"]
    assert {r["track_id"] for r in catalog.search(c, "VARI").collect()} == {3} and catalog.search(c, "").count() == 3
    assert catalog.search(c, "song", catalog.ARTIST).count() == 0
    assert [(r["pos"], r["track_id"]) for r in catalog.lookup(c, ["Song", "no", "Song"]).orderBy("pos").collect()] == [(0, 2), (1, None), (2, 2)]
    with pytest.raises(LookupError):
        catalog.lookup(c, ["no"], strict=True)


def test_ingest(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    known = spark.createDataFrame([("b",), ("gone",)], "path string")
    new = ingest.missing(files, known, "path")
    assert new.count() == 2 and ingest.missing(new, new, "path").count() == 0 and ingest.pruned(known, files, "path").count() == 1
    assert ingest.write_if_any(new, str(tmp_path / "t")) and not ingest.write_if_any(new.where("false"), str(tmp_path / "u")) and not (tmp_path / "u").exists()
    ids = spark.range(10).select(F.col("id").alias("track_id"))
    assert [r["part"] for r in ingest.split(ids, 4).orderBy("track_id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]
    assert [r["part"] for r in ingest.split(ids.where("track_id < 3"), 5).orderBy("track_id").collect()] == [0, 1, 2]
    assert ingest.load_once(["a.hdb", "b.txt", "a.hdb"]) == ["a.hdb"]


def test_radio_state():
    s = radio.Session()
    for t in range(1, 6):
        s.apply("like", t)
        s.apply("next", t)
    assert list(s.likes) == [2, 3, 4, 5] and list(s.recents) == [2, 3, 4, 5] and s.seeds() == [2, 3, 4, 5, 2, 3, 4, 5]
    s.apply("dislike", 99)
    s.apply("dislike", 3)
    assert list(s.recents) == [2, 4, 5]
    assert radio.retry([1]) is None and radio.retry([1, 2, 3]) == 2


def test_next_track(spark):
    p = points(spark)
    names = spark.createDataFrame([(i, f"t{i % 7}", "A") for i in range(8)], "track_id long, title string, artist string")
    assert radio.next_track(p, names, radio.Session(excluded=[1]), 0, "euclidean").first()["track_id"] == 4
    assert radio.next_track(p, names, radio.Session(excluded=range(8)), 0, "euclidean").count() == 0
