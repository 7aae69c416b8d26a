"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder of this run inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: computes df once and keeps it in the shared folder, where it outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys up to which a semi-join with them is broadcast (some tens of bytes each); beyond it Spark shuffles both sides.
BROADCAST_KEYS = 500_000


def only(rows: DataFrame, keys: DataFrame, on: str | list[str] = "doc_id") -> DataFrame:
    """Rows whose key is among keys, which are distinct and already computed."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def all_but(rows: DataFrame, keys: DataFrame, on: str | list[str] | Column = "doc_id") -> DataFrame:
    """Rows whose key is not among keys, which are distinct and already computed."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_anti")


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the byte-wise lower() of the Python side does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each window of n word hashes, in order."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    count = len(hashes) - n + 1
    total = np.full(count, np.uint64(n), np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
    return mixed(total)


#: Bytes that are hashed at once; longer texts go in pieces that end at white space where there is some.
AT_ONCE = 1 << 18
#: The multiplier of the words' hash and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Tables:
    """Values of bytes, and the multiplier's powers and inverse powers, made once in each worker."""

    def __init__(self):
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))
        self.size = -1

    def reach(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, AT_ONCE)
            self.powers, self.inverses = (np.full(self.size + 1, x, np.uint64) for x in (FACTOR, pow(FACTOR, -1, 1 << 64)))
            self.powers[0] = self.inverses[0] = 1
            np.cumprod(self.powers, out=self.powers)
            np.cumprod(self.inverses, out=self.inverses)


TABLES = Tables()


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about AT_ONCE bytes that part no word."""
    at = 0
    while len(text) - at > AT_ONCE:
        stop = at + AT_ONCE
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def word_hashes(text: bytes, edges: np.ndarray = SPACE) -> np.ndarray:
    """One 64-bit hash, never 0, for each word of a text in order, without the bytes at its ends that edges (white space among them) marks.

    Words of such bytes alone have none. A word's hash is its bytes' values times powers of FACTOR by place, modulo 2**64,
    mixed: differences of one running sum over the text.
    """
    out = []
    for piece in pieces(text):
        a = np.frombuffer(piece, np.uint8)
        TABLES.reach(len(a))
        gap = np.ones(len(a) + 2, np.int8)
        gap[1:-1] = SPACE[a]
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        start, stop = turns[::2], turns[1::2]
        if edges is not SPACE:
            inner = ~edges[a]
            places, before = np.flatnonzero(inner), np.zeros(len(a) + 1, np.int64)
            np.cumsum(inner, out=before[1:])
            first, last = before[start], before[stop]
            full = first < last
            start, stop = places[first[full]], places[last[full] - 1] + 1
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(TABLES.values[a] * TABLES.powers[: len(a)], out=sums[1:])
        out.append(mixed((sums[stop] - sums[start]) * TABLES.inverses[start]))
    h = out[0] if len(out) == 1 else np.concatenate(out)
    h[h == 0] = 1
    return h


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
