"""Aggregates of a user's own over rows of numbers: zero, add, merge and final, with states merged across tasks.

A state is one array of doubles, so that it travels as an Arrow list. Each task adds its rows to one state a key, states of
a key then meet in PARTS parts, by the partition they come from, so that a repeated task changes no part, and at last in one
place; no group's rows are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the states of one key are dealt to before the last merge.
PARTS = 16
#: Doubles of states that a task holds before it passes them on.
HELD = 4_000_000


class Aggregate(Protocol):
    """merge has to be associative and commutative, with zero as its neutral state."""

    def zero(self, size: int) -> np.ndarray:
        """The state of no rows of size values each."""

    def add(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The state after rows, an array of (rows, values)."""

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def final(self, state: np.ndarray) -> np.ndarray:
        """The result, an array of doubles."""


class HellingerMean:
    """The squared mean of square roots, cell by cell: the centroid under the Hellinger distance."""

    def zero(self, size: int) -> np.ndarray:
        return np.zeros(size + 1)

    def add(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.merge(state, np.concatenate(([len(rows)], np.sqrt(rows).sum(axis=0))))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def final(self, state: np.ndarray) -> np.ndarray:
        return (state[1:] / state[0]) ** 2


class Moments:
    """(n, means, sample variances), merged by the parallel formula, which doesn't lose digits to large means."""

    def zero(self, size: int) -> np.ndarray:
        return np.zeros(2 * size + 1)

    def add(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        mean = rows.mean(axis=0)
        return self.merge(state, np.concatenate(([len(rows)], mean, ((rows - mean) ** 2).sum(axis=0))))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size, n = len(a) // 2, a[0] + b[0]
        if not n:
            return a
        d = b[1 : size + 1] - a[1 : size + 1]
        return np.concatenate(([n], a[1 : size + 1] + d * (b[0] / n), a[size + 1 :] + b[size + 1 :] + d * d * (a[0] * b[0] / n)))

    def final(self, state: np.ndarray) -> np.ndarray:
        size, n = len(state) // 2, state[0]
        return np.concatenate((state[: size + 1], state[size + 1 :] / (n - 1) if n > 1 else np.full(size, np.nan)))


def merged(df: DataFrame, key: Column, values: Column, aggregate: Aggregate) -> DataFrame:
    """(key, result): the aggregate of each key's values (array<double>, equally long within a key; bigint keys).

    Rows with a null key, null values or a null among them are left out; an empty table gives no rows; repeated rows count each.
    """
    rows = df.select(key.cast("long").alias("key"), values.cast("array<double>").alias("values")).where("key is not null and values is not null and not exists(values, x -> x is null)")
    schema = pa.schema([("key", pa.int64()), ("state", pa.list_(pa.float64()))])

    def out(states: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(states), pa.int64()), pa.array([s.tolist() for s in states.values()], schema.field(1).type)], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, held = {}, 0
        for b in batches:
            keys, lists = b.column(0).to_numpy(), b.column(1)
            order = np.argsort(keys, kind="stable")
            found, first = np.unique(keys[order], return_index=True)
            for k, places in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                own = lists.take(pa.array(places))
                table = own.flatten().to_numpy(zero_copy_only=False).reshape(len(places), -1)
                if k not in states:
                    states[k] = aggregate.zero(table.shape[1])
                    held += len(states[k])
                states[k] = aggregate.add(states[k], table)
            if held > HELD:
                yield out(states)
                states, held = {}, 0
        if states:
            yield out(states)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for own in b.column("state"):
                own = own.values.to_numpy(zero_copy_only=False)
                state = own if state is None else aggregate.merge(state, own)
        yield out({key[0].as_py(): state})

    def last(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in meet(key, batches):
            yield out({b.column(0)[0].as_py(): aggregate.final(b.column(1)[0].values.to_numpy(zero_copy_only=False))})

    types = "key long, state array<double>"
    parts = rows.mapInArrow(partial, types).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    return parts.groupBy("key", "part").applyInArrow(meet, types).groupBy("key").applyInArrow(last, types).withColumnRenamed("state", "result")
