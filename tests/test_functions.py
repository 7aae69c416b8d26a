import math

import pytest
from pyspark.sql import functions as F

from bandwright.config import DEFAULT, EngineConfig
from bandwright.functions import arrays, distances, scales

A, B = [0.5, 0.25, 0.25, 0.0], [0.25] * 4
EXPECTED = {
    "kl": 0.4986770843, "jeffreys": 3.0707494415, "expected_value": 0.25, "expected_diff": 0.25, "k": 0.1430719234,
    "hellinger": 0.3826834324, "euclidean": 0.3535533906, "jensen": 0.1074670676,
}


def arr(values):
    return F.array(*map(F.lit, values))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("name", EXPECTED)
def test_distance(spark, name):
    assert one(spark, distances.total(name)(F.array(arr(A)), F.array(arr(B)))) == pytest.approx(EXPECTED[name], abs=1e-8)
    kept, function = distances.prepared(F.col("h"), name)
    row = spark.range(1).select(F.array(arr(A)).alias("a"), F.array(arr(B)).alias("b"))
    swap = lambda c: distances.prepared(F.col(c), name)[0]
    assert row.select(function(swap("a"), swap("b")).alias("d")).first()[0] == pytest.approx(EXPECTED[name], abs=1e-8)


@pytest.mark.parametrize("name", ["jeffreys", "expected_diff", "hellinger", "euclidean", "jensen"])
def test_symmetry(spark, name):
    d = distances.total(name)
    assert one(spark, d(F.array(arr(A)), F.array(arr(B)))) == pytest.approx(one(spark, d(F.array(arr(B)), F.array(arr(A)))))


def test_smoothing_once(spark):
    h = one(spark, distances.smooth(arr([0.5, 0.5] + [0.0] * 126)))
    assert min(h) == pytest.approx(9.8755e-05, rel=1e-4) and max(h) == pytest.approx(0.493777, rel=1e-5) and sum(h) == pytest.approx(1)


def test_registry(spark):
    assert [r["name"] for r in distances.listing(spark).orderBy("id").collect()] == list(distances.REGISTRY)
    assert distances.by_display_name("Jensen difference") == "jensen" and distances.by_display_name("?") == "hellinger"
    with pytest.raises(ValueError):
        distances.total("nothing")
    assert one(spark, distances.total(lambda a, b: F.lit(2.0))(F.array(arr(A), arr(A)), F.array(arr(B), arr(B)))) == 4.0


def test_edges():
    mel = "128 252 395 560 749 967 1217 1505 1837 2218 2656 3160 3740 4407 5174 6057 7072 8239 9582 11126 12903 14946 17296 20000"
    bark = "98 182 274 373 483 602 735 881 1045 1228 1436 1672 1943 2259 2630 3072 3609 4273 5118 6228 7750 9968 13499 19999"
    semitone = "26 35 47 63 84 112 149 199 266 355 474 632 843 1124 1499 1999 2667 3556 4742 6324 8433 11246 14997 19999"
    for name, text in (("mel", mel), ("bark", bark), ("semitone", semitone)):
        assert all(abs(a - int(b)) <= 1 for a, b in zip(scales.band_edges(24, name), text.split(), strict=True))
    first = [scales.band_of_bin(2048, 44100, scales.band_edges(24)).index(b) for b in range(24)]
    assert first == [0, 6, 12, 19, 27, 35, 45, 57, 70, 86, 104, 124, 147, 174, 205, 241, 282, 329, 383, 445, 517, 600, 695, 804]
    with pytest.raises(ValueError):
        scales.band_edges(1)


def test_weights_and_scales():
    assert scales.loudness_weights([3700, 25, 30000]) == pytest.approx([1.0, (0.6194690265486725 + 0.6796116504854368) / 2, 1.0])
    for name in scales.TO_SCALE:
        assert scales.TO_HERTZ[name](scales.TO_SCALE[name](440.0)) == pytest.approx(440.0)


@pytest.mark.parametrize(("value", "bin_"), [(-0.1, 0), (0.0, 0), (1 / 128, 1), (0.999, 127), (1.0, 127), (7.0, 127)])
def test_bins(spark, value, bin_):
    assert one(spark, arrays.bin_of(F.lit(value), 128)) == bin_


def test_scalars(spark):
    assert one(spark, arrays.mm_ss(F.lit(125))) == "02:05"
    assert [one(spark, arrays.pair_index(F.lit(i), F.lit(j))) for i, j in ((1, 0), (2, 0), (2, 1), (3, 0))] == [0, 1, 2, 3]
    assert one(spark, arrays.power_of_two_floor(F.lit(63))) == 32
    assert one(spark, arrays.near_zero(arr([1e-6, 0.0])))
    assert [one(spark, c) for c in arrays.rgb_bytes(F.lit(1.0))] == [255, 255, 255]
    assert math.copysign(1, one(spark, arrays.rounded(F.lit(-1e-12)))) == 1


def test_config():
    assert DEFAULT.min_frames == 344
    with pytest.raises(ValueError):
        EngineConfig(window=8, step=16)
