"""A test for each finding of the round that led to a change."""

import numpy as np
from pyspark.sql import functions as F

from bandwright.config import SMALL
from bandwright.operators import cluster, pairs, radio, signal, similarity, stats
from bandwright.sources import files, standins
from bandwright.streaming import ingest as continuous


def test_report_rounds_as_printf(spark):
    """0.4140295 lies below its decimal text, so %f ends in 029; large values have no grouping."""
    values = [0.4140295, 0.5, 2.5e-7, 1234567.125]
    answer = spark.createDataFrame([(i, i, v) for i, v in enumerate(values)], "rank int, track_id long, distance double")
    names = spark.createDataFrame([(i, "t", "a", "b") for i in range(len(values))], "track_id long, title string, artist string, album string")
    lines = [r["line"].split("\t")[0] for r in similarity.report(answer, names).orderBy("rank").collect()]
    assert lines == ["%f" % v for v in values]
    wide = spark.createDataFrame([(0, [1234.00005]), (1, [0.00005])], "frame_no long, bands array<double>")
    line = stats.stats_report(stats.band_stats(wide)).select(F.split("line", " ").alias("x")).first()["x"]
    assert line[:2] == ["%.4f" % 0.00005, "%.4f" % 1234.00005]


def test_wave_files_lie_in_lots(spark, tmp_path, monkeypatch):
    """no more than a lot's files are in the shared folder, and all rows are there at the end."""
    spark.range(-2, 23).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(standins, "LOT_FILES", 4)
    seen = []

    def query(folder):
        seen.append(len(list((tmp_path / "lots" / "audio").glob("*.wav"))))
        return files.contents(spark, folder).select(files.stem(F.col("path")).cast("long").alias("k"), F.length("content").alias("n"))

    rows = standins.by_lots(spark, str(tmp_path), f"file://{tmp_path}/lots", query, 1, 8000).collect()
    assert sorted(r["k"] for r in rows) == list(range(-2, 23)) and {r["n"] for r in rows} == {16044}
    assert len(seen) == 7 and sum(seen) == 25 and max(seen) <= 4 and not (tmp_path / "lots" / "audio").exists()


def test_tone_by_recurrence_equals_sines():
    for key, seconds, rate in ((0, 1, 8000), (35, 1, 8000), (59_999, 2, 44100)):
        t = np.arange(seconds * rate) / rate
        x = sum(np.sin(2 * np.pi * 110.0 * 2 ** (key % 36 / 12) * k * t + key) / k for k in range(1, 9))
        found = np.frombuffer(standins.tone(key, seconds, rate)[44:], "<i2").astype(int)
        assert len(found) == len(x) and np.abs(found - (x / 3 * 32000).astype("<i2")).max() <= 1
        assert (found != (x / 3 * 32000).astype("<i2")).sum() <= 2


def test_stem_costs_no_walk_over_the_path(spark):
    """stems of long paths took some 48 CPU microseconds, most of the query; results are as before."""
    paths = ["/a/b.c/d.e.wav", "x", "x.", ".x", "..", "a/", "", "file:///s p/1.wav", "a/b\n", "a.b/c", "é/ü.ü.mp3", "/", "a//b."]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    before = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    assert rows.where(files.stem(F.col("path")) != before).count() == 0
    assert "substring_index" in rows.select(files.stem(F.col("path")))._jdf.queryExecution().toString()


def random_tracks(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    h = rng.random((n, 2, 4))
    h /= h.sum(axis=-1, keepdims=True)
    return h, spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(h)], "track_id long, hist array<array<double>>").repartition(3)


def test_pairs_shuffle_blocks_alone(spark, monkeypatch):
    """rows are not copied for each block they meet, and the printed matrix shuffles no pairs."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)
    h, tracks = random_tracks(spark, 60)
    found = pairs.triangle(tracks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan
    d = {(r["i"], r["j"]): r["dist"] for r in found.collect()}
    assert len(d) == 60 * 59 // 2
    for (i, j), x in d.items():
        assert i > j and abs(x - np.sqrt(np.maximum(0, 1 - np.sqrt(h[i // 3] * h[j // 3]).sum(-1))).sum()) < 1e-9
    lines = {r["i"]: r["line"] for r in pairs.printed_triangle(tracks).collect()}
    assert lines == {3 * i: " ".join("%.2f" % d[3 * i, 3 * j] for j in range(i)) for i in range(1, 60)}
    whole = pairs.mirrored(found, tracks)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("CartesianProduct") == 1


def test_matrix_texts_round_as_printf():
    values = np.array([0.125, 0.375, 0.005, 0.015, 1.005, 0.0, 2.0, 0.994999999999, 12345.678, float("nan")])
    assert pairs.texts(values, 2) == ["%.2f" % v for v in values]


def test_seeds_come_once_for_a_block_of_sessions(spark, monkeypatch):
    """sessions don't carry their seeds' cells, and a seed's distances are taken once a block, however few a task keeps."""
    _, tracks = random_tracks(spark, 40)
    tracks = tracks.withColumn("exclude", F.lit(False))
    names = tracks.select("track_id", F.lit("x").alias("name")).where("track_id < 0")
    rows = [(s, [3 * (s % 5)], [3 * (s % 7), 3 * (s % 7)], [6, 9], None) for s in range(30)] + [(99, [], [], [], 12), (100, [], [], [], None), (101, [-5], [], [], None)]
    states = spark.createDataFrame(rows, radio.STATE)
    found = radio.picks(states, tracks, names, 33, 40)
    assert "seed_cells" not in found._jdf.queryExecution().toString()
    expected = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(radio, "KEPT_SEEDS", 1)
    assert sorted(map(tuple, radio.picks(states, tracks, names, 33, 40).collect())) == expected
    assert [r[0] for r in expected] == [*range(30), 99]
    for s, track, d in expected[:3]:
        _, likes, recents, excluded, _ = rows[s]
        best = radio.next_track(tracks.drop("exclude").withColumn("exclude", F.lit(False)), tracks.select("track_id", F.lit("t").alias("title"), F.lit("a").alias("artist")).limit(0), radio.Session(likes, recents, excluded), 0).first()
        assert (best["track_id"], round(best["distance"], 6)) == (track, round(d, 6))


def test_gabor_gives_short_streams_together(spark, monkeypatch):
    """a batch holds many short streams; where it ends changes nothing."""
    rows = spark.range(600).select((F.col("id") % 30).alias("track_id"), F.floor(F.col("id") / 30).alias("pos"), F.lit(20).cast("long").alias("n"), F.rand(1).alias("value"))
    one = sorted(map(tuple, signal.gabor(rows, 400, 16).collect()))
    monkeypatch.setattr(signal, "GABOR_ROWS", 5)
    assert sorted(map(tuple, signal.gabor(rows, 400, 16).collect())) == one and len(one) == 30 * 12 * 2


def test_kmeans_shuffles_sums_alone(spark, monkeypatch):
    """a round neither explodes the points' cells nor joins points with their assignment; null cells and bands of unequal length count as before."""
    hist = [[[0.25, 0.75], [1.0]], [[1.0, 0.0], [None]], [[0.5, 0.5], [0.25]], [[0.0, 1.0], [0.0, 1.0]], None]
    points = spark.createDataFrame([(i, h) for i, h in enumerate(hist)], "track_id long, hist array<array<double>>").repartition(3)
    assigned = spark.createDataFrame([(i, i // 4) for i in range(5)], "track_id long, cluster_id int").withColumn("cluster_id", F.expr("if(track_id = 3, 1, cluster_id)"))
    found = cluster.centroids(points, assigned, cluster.EUCLIDEAN)
    assert {r["cluster_id"]: r["hist"] for r in found.collect()} == {0: [[1.75 / 3, 1.25 / 3], [0.625]], 1: [[0.0, 1.0], [0.0, 1.0]]}
    _, tracks = random_tracks(spark, 60)
    joined, plain = [], cluster.centroids
    monkeypatch.setattr(cluster, "centroids", lambda *a, **b: joined.append(1) or plain(*a, **b))
    answer, done = cluster.kmeans(tracks, 4)
    assert not joined and done
    centres = plain(tracks, answer)
    again = cluster.assign(tracks, centres).withColumnRenamed("cluster_id", "again")
    assert answer.count() == 60 and answer.join(again, "track_id").where("again <> cluster_id").isEmpty()


def test_stream_looks_files_up_in_few_tasks(spark, tmp_path, monkeypatch):
    """each file of a batch had a task of its own, twice, whose results went to the driver."""
    monkeypatch.setattr(continuous, "LISTING_TASKS", 3)
    spark.range(40).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    standins.wave_files(spark, str(tmp_path), f"file://{tmp_path}/audio", 1, 8000)
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get(continuous.LISTING)
    known = set(tracker.getJobIdsForGroup(None))
    query = continuous.follow(spark, f"file://{tmp_path}/audio", f"file://{tmp_path}/db", SMALL, ["wav"])
    query.awaitTermination()
    jobs = [tracker.getJobInfo(j) for j in {*tracker.getJobIdsForGroup(str(query.runId)), *tracker.getJobIdsForGroup(None)} - known]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    assert jobs and max(s.numTasks for s in stages if s) < 40
    assert continuous.tracks(spark, f"file://{tmp_path}/db").count() == 40 and spark.conf.get(continuous.LISTING) == before
