import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.operators import aggregates

SCHEMA = "k long, v array<double>"


def rows_of(n=900):
    rng = np.random.default_rng(5)
    return [(0 if i % 3 else i % 7, [float(x) for x in rng.random(3) + 1e6 * (i % 3 == 0)]) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 16, 211])
def test_moments_do_not_depend_on_partitions(spark, partitions):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = {r["key"]: r["result"] for r in aggregates.merged(df, F.col("k"), F.col("v"), aggregates.Moments()).collect()}
    assert set(found) == {k for k, _ in rows}
    for k, result in found.items():
        own = np.array([v for j, v in rows if j == k])
        assert result[0] == len(own) and np.allclose(result[1:4], own.mean(axis=0), rtol=1e-12) and np.allclose(result[4:], own.var(axis=0, ddof=1), rtol=1e-6)


def test_states_are_passed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "HELD", 0)
    df = spark.createDataFrame([(k % 5, [1.0 + k // 5]) for k in range(500)], SCHEMA)
    assert {(r["key"], tuple(r["result"][:2])) for r in aggregates.merged(df, F.col("k"), F.col("v"), aggregates.Moments()).collect()} == {(k, (100.0, 50.5)) for k in range(5)}


def test_nulls_single_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [2.0]), (None, [1.0]), (2, None), (3, [None]), (4, [1.0]), (4, [1.0])], SCHEMA)
    found = {r["key"]: r["result"] for r in aggregates.merged(df, F.col("k"), F.col("v"), aggregates.Moments()).collect()}
    assert set(found) == {1, 4} and found[1][:2] == [1.0, 2.0] and math.isnan(found[1][2]) and found[4] == [2.0, 1.0, 0.0]
    assert aggregates.merged(df.limit(0), F.col("k"), F.col("v"), aggregates.HellingerMean()).count() == 0
