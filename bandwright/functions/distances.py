"""Distances between normalised histograms, as Column builders.

Each takes two histograms of one band (arrays of double) and gives a double. total() sums one over the bands. Asymmetric
ones take the seed first. Smoothing is pure and applied once to each side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells below it are raised to it by smooth().
FLOOR = 1e-4
Distance = Callable[[Column, Column], Column]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def smooth(h: Column) -> Column:
    """Raises cells below FLOOR to it and divides all cells by 1 + the total raise; unchanged if none was below."""
    raised = _sum(F.transform(h, lambda x: F.greatest(F.lit(0.0), FLOOR - x)))
    return F.transform(h, lambda x: F.greatest(x, F.lit(FLOOR)) / (1 + raised))


def _position(h: Column) -> Column:
    """Centres i / (L - 1) as an array beside h."""
    return F.transform(h, lambda x, i: i / F.greatest(F.size(h) - 1, F.lit(1)))


def kl(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * F.log2(x / y)))


def jeffreys(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * F.log2(x / y)))


def expected_value(a: Column, b: Column) -> Column:
    mean = lambda h: _sum(F.zip_with(h, _position(h), lambda x, p: x * p))
    return F.abs(mean(a) - mean(b))


def expected_diff(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), _position(a), lambda d, p: d * p))


def k_divergence(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * F.ln(2 * x / (x + y))))


def hellinger(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1 - _sum(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def jensen(a: Column, b: Column) -> Column:
    half = lambda x, y: (x + y) / 2
    return _sum(F.zip_with(a, b, lambda x, y: (x * F.ln(x) + y * F.ln(y)) / 2 - half(x, y) * F.ln(half(x, y))))


#: In the order of their ids: name, display name, builder, whether both sides are smoothed.
REGISTRY: dict[str, tuple[str, Distance, bool]] = {
    "kl": ("Kullback-Leibler divergence", kl, True),
    "jeffreys": ("Jeffreys divergence", jeffreys, True),
    "expected_value": ("Expected value difference", expected_value, False),
    "expected_diff": ("Expected difference", expected_diff, False),
    "k": ("K divergence", k_divergence, True),
    "hellinger": ("Hellinger distance", hellinger, False),
    "euclidean": ("Euclidean distance", euclidean, False),
    "jensen": ("Jensen difference", jensen, True),
}
DEFAULT = "hellinger"


def total(distance: str | Distance) -> Distance:
    """The sum of a distance over the bands of two arrays of histograms. A callable is taken as it is."""
    if callable(distance):
        function, smoothed = distance, False
    elif distance in REGISTRY:
        _, function, smoothed = REGISTRY[distance]
    else:
        raise ValueError(f"unknown distance {distance!r}; known: {', '.join(REGISTRY)}")
    one = (lambda a, b: function(smooth(a), smooth(b))) if smoothed else function
    return lambda h1, h2: _sum(F.zip_with(h1, h2, one))


def prepared(h: Column, distance: str | Distance) -> tuple[Column, Distance]:
    """The histogram column to keep for each row, and the distance of two such columns: what depends on one side is done once a row."""
    if distance == "hellinger":
        roots = F.transform(h, lambda band: F.transform(band, F.sqrt))
        return roots, lambda a, b: _sum(F.zip_with(a, b, lambda x, y: F.sqrt(F.greatest(F.lit(0.0), 1 - _sum(F.zip_with(x, y, lambda p, q: p * q))))))
    if not callable(distance) and distance in REGISTRY and REGISTRY[distance][2]:
        function = REGISTRY[distance][1]
        return F.transform(h, smooth), lambda a, b: _sum(F.zip_with(a, b, function))
    return h, total(distance)


def by_display_name(name: str, current: str = DEFAULT) -> str:
    """The distance of a display name; an unknown one changes nothing."""
    return next((k for k, (shown, *_) in REGISTRY.items() if shown == name), current)


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v[0]) for i, (k, v) in enumerate(REGISTRY.items())], "id int, name string, display string")
