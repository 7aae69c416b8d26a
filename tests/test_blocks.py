"""Operators that work on blocks give what their definitions give, wherever the blocks end."""

import math

import numpy as np
import pytest

from bandwright.operators import signal, stats


def direct_gabor(x, rate, step):
    out, margin = {}, math.sqrt(2 * math.log(1e4))
    for k in range(24, 12 * signal.gabor_octaves(rate)):
        den = 2 ** (-k / 12)
        for u in range(0, len(x), step):
            at = np.arange(max(0, math.floor(u - margin * den * rate)), min(len(x), math.floor(u + margin * den * rate)))
            t = (at - u) / rate / den
            out[k, u] = abs((np.exp(-0.5 * t * t + 2j * np.pi * 16.352 * t) / math.sqrt(den) * x[at]).sum())
    return out


@pytest.mark.parametrize("least", [16, 1 << 14])
def test_gabor(spark, monkeypatch, least):
    monkeypatch.setattr(signal, "LEAST_BLOCK", least)
    rng = np.random.default_rng(5)
    streams = {1: rng.normal(size=3000), 2: rng.normal(size=7)}
    rows = [(t, i, len(x), float(v)) for t, x in streams.items() for i, v in enumerate(x)]
    found = {(r["track_id"], r["k"], r["u"]): r["power"] for r in signal.gabor(spark.createDataFrame(rows, "track_id long, pos long, n long, value double").repartition(3), 300, 50).collect()}
    expected = {(t, *key): v for t, x in streams.items() for key, v in direct_gabor(x, 300, 50).items()}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())
    with pytest.raises(ValueError):
        signal.gabor(spark.createDataFrame(rows[:1], "track_id long, pos long, n long, value double"), 20, 5)


@pytest.mark.parametrize("rows", [1, 4, 7, 512])
def test_self_means(spark, rows):
    rng = np.random.default_rng(6)
    tracks = {1: rng.random((23, 3)), 2: rng.random((1, 3)), 3: rng.random((8, 3))}
    frames = spark.createDataFrame([(t, 2 * i, x.tolist()) for t, m in tracks.items() for i, x in enumerate(m)], "track_id long, frame_no int, bands array<double>")
    found = {(r["track_id"], r["i"]): r["mean"] for r in stats.self_means(frames.repartition(2), rows).collect()}
    plain = {(r["track_id"], r["i"]): r["mean"] for r in stats.row_means(stats.self_similarity(frames)).collect()}
    assert found.keys() == plain.keys() and len(found) == 32 and all(found[k] == pytest.approx(v, abs=1e-12) for k, v in plain.items())


@pytest.mark.parametrize("compat", [False, True])
def test_tempo_of_any_length(spark, compat):
    rng = np.random.default_rng(7)
    series = {(1, 0): rng.random(37), (1, 1): np.full(37, 2.0), (2, 0): rng.random(1), (3, 0): rng.random(64)}
    rows = [(t, b, i, float(v)) for (t, b), x in series.items() for i, v in enumerate(x)]
    found = {(r["track_id"], r["f"]): r["power"] for r in signal.tempo_spectrum(spark.createDataFrame(rows, "track_id long, band int, i int, value double"), 600.0, compat).collect()}
    for t, n in ((1, 37), (2, 1), (3, 64)):
        total = np.zeros(n // 2 + 1)
        for (own, _), x in series.items():
            if own == t:
                unit = (x - x.min()) / x.max()
                unit = unit - (unit.sum() if compat else unit.mean())
                turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n) @ unit
                total += (turn.real * turn.imag) ** 2 if compat else abs(turn) ** 2
        for f in range(n // 2 + 1):
            assert found[t, f] == pytest.approx(0 if f == 0 or f * 600 / n < 5 else math.sqrt(total[f] / n), abs=1e-9)
