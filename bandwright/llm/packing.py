"""Packing by minimum bin slack.

Of a document's ids, whole windows of the capacity become sequences; the rest waits in the task's pool. A window takes the
longest waiting piece and, by a bitset subset-sum over the other lengths and their counts, the multiset that fills it
closest to the capacity; the counts come from walking the bitsets back. A window that stays short is filled by cutting a
piece. What a task has left at its end goes into sequences whose lengths are powers of two, which need no padding.
Every task packs its own input partition: no shuffle, and a pool of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import texts_of
from bandwright.llm.tokens import tokenizer

CAPACITY = 2048
#: Pieces in the pool that start packing, and that it keeps for later windows.
POOL, KEEP = 2048, 512
#: (doc_id, start, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length together come closest to room without exceeding it."""
    reach, limit, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & limit
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            chosen[length] += k
    return chosen


class Packer:
    """add() pieces; take finished sequences (lists of pieces) from done."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.pool, self.waiting, self.done = capacity, defaultdict(list), 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for i in range(0, whole, self.capacity):
            self.done.append([(doc_id, i, ids[i : i + self.capacity], len(ids))])
        if whole < len(ids):
            self.put((doc_id, whole, ids[whole:], len(ids)))
        if self.waiting >= POOL:
            while self.waiting > KEEP:
                self.window()

    def put(self, piece: Piece) -> None:
        self.pool[len(piece[2])].append(piece)
        self.waiting += 1

    def pop(self, length: int) -> Piece:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def window(self) -> None:
        pieces = [self.pop(max(self.pool))]
        room = self.capacity - len(pieces[0][2])
        for length, k in best_fill({n: len(p) for n, p in self.pool.items()}, room).items():
            pieces += [self.pop(length) for _ in range(k)]
            room -= length * k
        if room and self.pool:
            doc_id, start, ids, tokens = self.pop(max(self.pool))
            pieces.append((doc_id, start, ids[:room], tokens))
            self.put((doc_id, start + room, ids[room:], tokens))
        self.done.append(pieces)

    def finish(self) -> None:
        while sum(n * len(p) for n, p in self.pool.items()) >= self.capacity:
            self.window()
        left = sum(n * len(p) for n, p in self.pool.items())
        size = self.capacity
        while left:
            while size > left:
                size //= 2
            pieces, room = [], size
            while room:
                doc_id, start, ids, tokens = self.pop(max(self.pool))
                pieces.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    self.put((doc_id, start + room, ids[room:], tokens))
                room -= len(pieces[-1][2])
            self.done.append(pieces)
            left -= size


PIECES = "array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"


def sequences(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, kept: tuple[int, int] | None = None) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of docs (doc_id, text): ids as little-endian 32-bit numbers.

    Each document's ids end with end_id; a null or empty text is that id alone. Null and repeated ids are packed as they
    come. Sequences shorter than the capacity have a power of two as length; capacity must be one too.
    kept bounds the words that a worker keeps (`tokens.FEW`); it changes no result.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = pa.struct([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "offset")])
    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(kind))])

    def rows(done: list[list[Piece]], first: int) -> pa.RecordBatch:
        ids = [np.concatenate([p[2] for p in s]).astype("<u4") for s in done]
        pieces = []
        for s in done:
            offsets = np.cumsum([0] + [len(p[2]) for p in s]).tolist()
            pieces.append([{"doc_id": p[0], "start": p[1], "length": len(p[2]), "doc_tokens": p[3], "offset": o} for p, o in zip(s, offsets, strict=False)])
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(done)), pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(pieces, schema.field("pieces").type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end = Packer(capacity), np.array([end_id], np.uint32)
        first = TaskContext.get().partitionId() << 33
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer(path, kept).encode_all(texts_of(b.column(1))), strict=True):
                packer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), end))
                if len(packer.done) >= 256:
                    yield rows(packer.done, first)
                    first, packer.done = first + len(packer.done), []
        packer.finish()
        yield rows(packer.done, first)

    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows_in.mapInArrow(run, f"sequence_id long, n_tokens long, ids binary, pieces {PIECES}")


def pieces_digest(packed: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece, from the packed ids themselves."""
    each = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))")
    return each.select("p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
