"""Token-id files: fixed-width bit packing with block offsets.

A file holds the documents of one range of ids, in ascending order. Ids take the least bits that the vocabulary needs and
lie in blocks of BLOCK ids; a block starts at a byte, so any range of ids is read by its blocks alone.

    magic, bits (u32), ids a block (u32) | blocks | block offsets (u64) | document ids (i64), which are null (u8), their
    first id in the file (u64) | numbers of blocks, documents and ids (u64), place of the block offsets (u64), magic
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.llm.common import batch, cut, run_dir, texts_of
from bandwright.llm.tokens import tokenizer, vocabulary_size

MAGIC = b"IDBITS01"
BLOCK = 8192
#: Tasks that a list of files is dealt to at most.
MOST_TASKS = 20_000
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.out.write(HEAD.pack(MAGIC, bits, block))
        self.at, self.offsets, self.pending, self.size, self.total = HEAD.size, [], [], 0, 0
        self.doc_ids, self.nulls, self.starts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.total)
        self.total += len(ids)
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= 16 * self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, stop, self.block):
            data = pack_bits(ids[i : min(i + self.block, stop)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.pending, self.size = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self.flush(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(TAIL.pack(len(self.offsets), len(self.doc_ids), self.total, self.at, MAGIC))
        self.out.close()


class Reader:
    """source: a seekable file. ids(start, stop) reads only the blocks that hold these ids."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block = HEAD.unpack(self.bytes(0, HEAD.size))
        blocks, docs, self.total, at, end = TAIL.unpack(self.bytes(source.size() - TAIL.size, TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token-id file")
        index = self.bytes(at, 8 * blocks + 17 * docs)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks), at)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(index, "u1", docs, 8 * blocks + 8 * docs).astype(bool)
        self.starts = np.append(np.frombuffer(index, "<u8", docs, 8 * blocks + 9 * docs), self.total).astype(np.int64)

    def bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        count = min((last + 1) * self.block, self.total) - first * self.block
        return unpack_bits(data, count, self.bits)[start - first * self.block : stop - first * self.block]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order, reading about at_once ids at a time."""
        i = 0
        while i < len(self.doc_ids):
            stop = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + at_once, "right")) - 1)
            base = int(self.starts[i])
            ids = self.ids(base, int(self.starts[stop]))
            for k in range(i, stop):
                yield None if self.nulls[k] else int(self.doc_ids[k]), int(self.starts[k]), ids[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]
            i = stop


def write(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Writes the ids of docs (doc_id, text), end_id after each document, and returns (file, n_docs, n_ids, base) of the files.

    A null text is an empty one; a null id comes first; rows with equal ids stand in the order of their texts' hashes.
    A task that runs again writes another file; only files named here count.
    """
    bits = max(1, int(max(vocabulary_size(path) - 1, end_id)).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("first_tie", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, end = None, None, np.array([end_id], np.uint32)
        for b in batches:
            if b.num_rows and writer is None:
                where, inside = fs.FileSystem.from_uri(folder)
                where.create_dir(inside, recursive=True)
                name = f"{uuid.uuid4().hex}.ids"
                writer, first = Writer(where.open_output_stream(f"{inside}/{name}"), bits), (b.column(0)[0].as_py(), b.column(2)[0].as_py())
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer(path).encode_all(texts_of(b.column(1))), strict=True):
                writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), end))
        if writer:
            writer.close()
            yield batch(schema, file=[f"{folder}/{name}"], n_docs=[len(writer.doc_ids)], n_ids=[writer.total], first_id=[first[0]], first_tie=[first[1]])

    files = cut(rows.mapInArrow(run, "file string, n_docs long, n_ids long, first_id long, first_tie long"))
    order = W.orderBy(F.asc_nulls_first("first_id"), "first_tie").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    return files.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the files (file, base); start counts the ids of all documents before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, inside = fs.FileSystem.from_uri(file)
                with where.open_input_file(inside) as source:
                    doc_ids, starts, out, size = [], [], [], 0
                    for doc_id, start, ids in Reader(source).documents():
                        doc_ids.append(doc_id)
                        starts.append(base + start)
                        out.append(ids.astype("<u4").tobytes())
                        size += len(ids)
                        if size >= 1 << 20:
                            yield batch(schema, doc_id=doc_ids, start=starts, ids=out)
                            doc_ids, starts, out, size = [], [], [], 0
                    yield batch(schema, doc_id=doc_ids, start=starts, ids=out)

    files = files.select("file", "base")
    return files.repartition(min(max(1, files.count()), MOST_TASKS)).mapInArrow(run, "doc_id long, start long, ids binary")


def token_file_digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes docs and reads the files back: (doc_id, start, n_tokens, ids_crc32)."""
    back = read(write(docs, path, end_id, run_dir(docs.sparkSession, "token-files")))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
