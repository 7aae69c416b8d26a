"""Perceptual frequency scales, band tables and loudness weights. Small tables, computed on the driver."""

from __future__ import annotations

import math

import numpy as np

LOWEST, HIGHEST = 20.0, 20000.0
#: Names say what is computed. Where a caller of the original interface asked for "bark", mel was computed, and the other way round.
SWAPPED = {"bark": "mel", "mel": "bark", "semitone": "semitone"}

TO_SCALE = {
    "mel": lambda f: 1127.0 * math.log(1 + f / 700.0),
    "bark": lambda f: 26.81 / (1 + 1960.0 / f) - 0.53,
    "semitone": lambda f: 12 * math.log2(f / 127.09),
}
TO_HERTZ = {
    "mel": lambda m: 700.0 * (math.exp(m / 1127.0) - 1),
    "bark": lambda b: 1960.0 / (26.81 / (b + 0.53) - 1),
    "semitone": lambda s: 127.09 * 2 ** (s / 12),
}
DISPLAY = {"mel": "Mel scale", "bark": "Bark scale", "semitone": "Semitone scale"}

# Frequency in Hz and inverse equal-loudness coefficient.
LOUDNESS = (
    (0, 0.5833333333333334), (20, 0.6194690265486725), (30, 0.6796116504854368), (40, 0.7216494845360825), (50, 0.7526881720430109),
    (60, 0.7692307692307693), (70, 0.7865168539325843), (80, 0.8045977011494253), (90, 0.813953488372093), (100, 0.8235294117647058),
    (200, 0.8974358974358975), (300, 0.9210526315789473), (400, 0.9210526315789473), (500, 0.9210526315789473), (600, 0.9210526315789473),
    (700, 0.9090909090909092), (800, 0.8974358974358975), (900, 0.8805031446540881), (1000, 0.8750000000000001), (1500, 0.8860759493670887),
    (2000, 0.9090909090909092), (2500, 0.9459459459459461), (3000, 0.9790209790209791), (3700, 1.0), (4000, 0.9929078014184397),
    (5000, 0.9459459459459461), (6000, 0.8860759493670887), (7000, 0.8333333333333333), (8000, 0.813953488372093), (9000, 0.813953488372093),
    (10000, 0.8235294117647058), (12000, 0.7368421052631579), (15000, 0.6363636363636364), (20000, 0.5600000000000001),
)


def band_edges(bands: int, scale: str = "mel") -> list[int]:
    """Upper edges in whole Hz of equal steps on a scale between 20 Hz and 20 kHz; 32-bit steps, as stored tables have."""
    if not 2 <= bands <= 20000 or scale not in TO_SCALE:
        raise ValueError("2 to 20000 bands on mel, bark or semitone")
    low, high = np.float32(TO_SCALE[scale](LOWEST)), np.float32(TO_SCALE[scale](HIGHEST))
    step = np.float32((high - low) / np.float32(bands))
    edges, at = [], np.float32(low + step)
    for _ in range(bands):
        edges.append(int(np.float32(TO_HERTZ[scale](float(at)))))
        at = np.float32(at + step)
    return edges


def loudness_weights(edges: list[int]) -> list[float]:
    """Linear between the table's points; 1 where no two points bracket the edge."""
    points = sorted(LOUDNESS)
    last = points[-1][0]
    f, c = [p[0] for p in points], [p[1] for p in points]
    return [float(np.interp(e, f, c)) if 0 <= e <= last else 1.0 for e in edges]


def bin_to_hertz(i: int, window: int, rate: int) -> float:
    return i * rate / window


def band_of_bin(window: int, rate: int, edges: list[int]) -> list[int]:
    """Band of each frequency bin: one band on at most for each bin that reaches the present band's edge; the last takes the rest."""
    bands, band = [], 0
    for i in range(window // 2 + 1):
        if band < len(edges) - 1 and bin_to_hertz(i, window, rate) >= edges[band]:
            band += 1
        bands.append(band)
    return bands
