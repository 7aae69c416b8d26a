"""Array and scalar Column helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def fixed(value: Column, digits: int) -> Column:
    """Text with so many decimals, rounded from the double's exact binary value as printf does, without grouping."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}").astype(object)

    return run(value)


def bin_of(value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Bin of a clamped value; the top value falls into the last bin."""
    unit = (value - low) / (high - low)
    return F.floor(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1 - 1 / bins)) * bins).cast("int")


def near_zero(values: Column, eps: float = 1e-5) -> Column:
    return F.forall(values, lambda x: F.abs(x) <= eps)


def power_of_two_floor(n: Column) -> Column:
    return F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")


def pair_index(i: Column, j: Column) -> Column:
    """Place of the pair i > j in a packed strict lower triangle."""
    return (i * (i - 1) / 2 + j).cast("long")


def mm_ss(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def rgb_bytes(value: Column, inverted: bool = False) -> tuple[Column, Column, Column]:
    """Red, green and blue of a value in [0, 1] spread over 24 bits, low byte first; inverted takes each from 255."""
    v = F.floor(value * 0xFFFFFF).cast("long")
    parts = (F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)) for k in range(3))
    return tuple(255 - p if inverted else p for p in parts)
