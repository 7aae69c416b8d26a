"""A test for each finding of the round that led to a change; F10 and F11 are in llm/test_substring_frequent.py."""

from bandwright.sources import standins


def test_tones_of_one_pitch_share_their_sums():
    """F6, F8, F9: sums of overtones were made anew for each file, most of the time of making it."""
    standins.overtones.cache_clear()
    files = [standins.tone(key, 1, 8000) for key in (5, 41, 77, 59_981)]
    assert standins.overtones.cache_info().misses == 1 and len(set(files)) == 4


def test_a_task_makes_few_pitches(spark, tmp_path, monkeypatch):
    """Each task's files follow each other by pitch, and hardly any pitch is in two tasks."""
    spark.range(720).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    seen = []

    def dealt(keys, folder, named):
        seen.extend(keys.rdd.glom().map(lambda rows: [r["s_suppkey"] % 36 for r in rows]).collect())
        return 0

    monkeypatch.setattr(standins, "write_files", dealt)
    standins.wave_files(spark, str(tmp_path), f"file://{tmp_path}/audio", 1, 8000)
    assert sum(map(len, seen)) == 720 and all(x == sorted(x) for x in seen)
    assert sum(len(set(x)) for x in seen) < 36 + len(seen)
