"""Byte-pair encoding of whole corpora through a table of distinct words, and decoding through the table of pieces.

Words are split in Spark and each distinct word is encoded once:

1. Documents are dealt into blocks of some million words. A block keeps its distinct words, the most frequent first, and
   each document its words' places among them (variable-length numbers). Both are written to the shared folder once.
2. The blocks' words go to buckets by hash, one row for each block and bucket. A bucket's distinct words are encoded once
   and their ids go back to all blocks. A word comes at most once a block, so frequent words are aggregated before the shuffle.
3. The ids go to the files of their blocks, which are bucketed by block and so need no shuffle, and are put in the order of
   the documents' places.

Decoding joins ids with the vocabulary's table (id, piece), whose size is the vocabulary's.

Rows: a null text is an empty one and has no ids; null ids decode to an empty text; rows that repeat an id or a text are
rows of their own; an empty table gives an empty one; texts are taken whole, one that is longer than a block is a block of
its own; only the columns named in keep are carried, whatever their names. Vocabularies whose ids depend on neighbouring
words (a probe tells) take whole texts for words.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import run_dir, texts_of
from bandwright.llm.tokens import AT_ONCE, SPECIAL, tokenizer, vocabulary_size

#: Words after which a block ends with its document, and words whose places are coded, and joined with ids, at once.
BLOCK_WORDS, SLICE_WORDS = 4_000_000, 600_000
#: Rows decoded at once.
ROWS_AT_ONCE = 500
NAMES = ["block", "kept", "counts", "codes", "bucket", "words", "sizes", "places"]


def to_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as groups of seven bits, low ones first, the last with its high bit set; and where each number ends."""
    sizes = np.ones(len(numbers), np.int64)
    for k in range(1, 5):
        sizes += numbers >= 1 << 7 * k
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        out[(ends - sizes)[has] + k] = numbers[has] >> 7 * k & 127
    out[ends - 1] |= 128
    return out, ends


def from_bytes(data: np.ndarray) -> np.ndarray:
    """Undoes to_bytes()."""
    last = np.flatnonzero(data & 128)
    first = np.concatenate(([0], last[:-1] + 1)).astype(np.int64)[: len(last)]
    out = np.zeros(len(last), np.int32)
    for k in range(5):
        has = np.flatnonzero(first + k <= last)
        if not len(has):
            break
        out[has] |= (data[first[has] + k] & 127).astype(np.int32) << 7 * k
    return out


def strings(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """A binary array of consecutive slices of data."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.Array | pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column behind each other as numbers, and where each row's end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind), (offsets[1:] - offsets[0]) // width


class Block:
    """Words of documents, numbered as they come."""

    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.rows, self.codes, self.size = [], [], 0

    def add(self, row, words: list[bytes]) -> None:
        places = self.places
        for w in Counter(words):
            if w not in places:
                places[w] = len(places)
        self.rows.append(row)
        self.codes.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def words(self) -> tuple[np.ndarray, list[bytes]]:
        """The rank by frequency of each number, and the words in that order."""
        counts = np.zeros(len(self.places), np.int64)
        for _, codes in self.slices():
            counts += np.bincount(np.concatenate(codes), minlength=len(counts))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words = list(self.places)
        return rank, [words[i] for i in order.tolist()]

    def slices(self, least: int = SLICE_WORDS) -> Iterator[tuple[list, list[np.ndarray]]]:
        """Rows and their words' numbers, a few documents at a time."""
        at = size = 0
        for stop, c in enumerate(self.codes, 1):
            size += len(c)
            if size >= least or stop == len(self.codes):
                yield self.rows[at:stop], self.codes[at:stop]
                at, size = stop, 0


def squeezed(data: bytes) -> bytes:
    """Size and compressed bytes."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def numbered(numbers: list[int] | np.ndarray) -> bytes:
    return to_bytes(np.asarray(numbers, np.int64))[0].tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    return from_bytes(np.frombuffer(data, np.uint8))


def blocks(docs: DataFrame, path: str, keep: list[str], text: str, words_a_block: int) -> DataFrame:
    """In the shared folder, in files by block: (block, kept, counts, codes) for some documents each, and (block, bucket, words, sizes, places) for the words of each block and bucket."""
    source = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))
    kept_type = source.schema["kept"].dataType.simpleString()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept_rows(kept: list) -> Iterator[pa.Array]:
        """Rows stand as (batch's column, place): slices of neighbours are put together again."""
        at = 0
        while at < len(kept):
            stop = at
            while stop < len(kept) and kept[stop][0] is kept[at][0]:
                stop += 1
            yield kept[at][0].slice(kept[at][1], stop - at)
            at = stop

    def rows(block: Block, number: int) -> Iterator[pa.RecordBatch]:
        rank, words = block.words()
        for kept, codes in block.slices():
            column = pa.concat_arrays(kept_rows(kept))
            data = squeezed(numbered(rank[np.concatenate(codes)]))
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.array([numbered(list(map(len, codes)))], pa.binary()), pa.array([data], pa.binary()), none.cast(pa.int32()), none, none, none],
                names=NAMES,
            )
        own = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(buckets + 1))
        parts = [order[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        filled = [k for k, part in enumerate(parts) if len(part)]
        each = [[words[i] for i in parts[k].tolist()] for k in filled]
        n = len(filled)
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * n, pa.int64()), pa.nulls(n, pa.list_(column.type)), none, none, pa.array(filled, pa.int32()), pa.array([squeezed(b"".join(ws)) for ws in each], pa.binary()),
                pa.array([squeezed(numbered([len(w) for w in ws])) for ws in each], pa.binary()), pa.array([numbered(np.diff(parts[k], prepend=0)) for k in filled], pa.binary()),
            ],
            names=NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizer(path), TaskContext.get().partitionId() << 32
        block = Block()
        for b in batches:
            column = b.column(0)
            for i, raw in enumerate(texts_of(b.column(1))):
                if t.folds and SPECIAL not in raw:  # special tokens keep their case
                    raw = raw.lower()
                block.add((column, i), raw.split() if t.by_word else [raw] if raw else [])
                if block.size >= words_a_block:
                    yield from rows(block, number)
                    block, number = Block(), number + 1
        if block.rows:
            yield from rows(block, number)

    spark, name = docs.sparkSession, f"words_{uuid.uuid4().hex}"
    made = source.mapInArrow(run, f"block long, kept array<{kept_type}>, counts binary, codes binary, bucket int, words binary, sizes binary, places binary")
    made.write.format("parquet").option("compression", "zstd").option("path", f"{run_dir(spark, 'words')}/rows").bucketBy(buckets, "block").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    return found


def width_of(path: str) -> int:
    """Bytes that an id needs."""
    return max(1, -(-(vocabulary_size(path) - 1).bit_length() // 8))


def parted(data: bytes, sizes: np.ndarray) -> list[bytes]:
    stops = np.cumsum(sizes).tolist()
    return [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(block, places, ids, sizes) of rows (block, bucket, words, sizes, places): a bucket's distinct words are encoded once.

    Ids take the bytes that the vocabulary needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, bucket, known = tokenizer(path), None, {}
        for b in batches:
            for k, (own, data, lengths) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if own != bucket:
                    bucket, known = own, {}
                found = parted(restored(data), numbers_of(restored(lengths)))
                new = [w for w in found if w not in known]
                for i in range(0, len(new), AT_ONCE):
                    known.update(zip(new[i : i + AT_ONCE], t.fresh(new[i : i + AT_ONCE]), strict=True))
                each = [known[w] for w in found]
                ids = np.frombuffer(b"".join(each), "u1").reshape(-1, 4)[:, : width_of(path)].tobytes()
                columns = [b.column(0).slice(k, 1), b.column(4).slice(k, 1), pa.array([squeezed(ids)], pa.binary()), pa.array([numbered([len(x) // 4 for x in each])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "places", "ids", "sizes"])

    together = words.select("block", "bucket", "words", "sizes", "places").repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, "block long, places binary, ids binary, sizes binary")


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words_a_block: int = BLOCK_WORDS) -> DataFrame:
    """The columns keep of each row, and ids: its text's token ids as little-endian 32-bit numbers (binary)."""
    written = blocks(docs, path, list(keep), text, words_a_block)
    rows = written.where("bucket is null").select("block", "kept", "counts", "codes")

    def join(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, places, ids, counts = width_of(path), [], [], []
        for b in right:
            places += [np.cumsum(numbers_of(x)) for x in b.column("places").to_pylist()]
            ids += [np.frombuffer(restored(x), "u1").reshape(-1, width) for x in b.column("ids").to_pylist()]
            counts += [numbers_of(x) for x in b.column("sizes").to_pylist()]
        found = np.concatenate([np.empty((0, width), "u1"), *ids])
        table = np.pad(found, ((0, 0), (0, 4 - width))).ravel().view("<u4")
        where, count = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (places, counts))
        size, start = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        size[where], start[where] = count, np.cumsum(count) - count
        for b in left:
            for k in range(b.num_rows):
                kept = b.column("kept").slice(k, 1).flatten()
                own = numbers_of(restored(b.column("codes")[k].as_py()))
                stops = np.cumsum(numbers_of(b.column("counts")[k].as_py()), dtype=np.int64)
                sizes = size[own]
                after = np.cumsum(sizes)
                at = np.repeat(start[own] - after + sizes, sizes)
                at += np.arange(len(at))
                out = strings(table[at].view(np.uint8), 4 * np.concatenate(([0], after))[stops])
                yield pa.RecordBatch.from_arrays([kept, out.cast(pa.binary())], names=["kept", "ids"])

    kept_type = rows.schema["kept"].dataType.elementType.simpleString()
    found = encoded_words(written.where("bucket is not null"), path)
    met = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(joined(join), f"kept {kept_type}, ids binary")
    return met.select("kept.*", "ids")


def joined(join):
    """For a pair of tables, which Spark's cogroup hands over, what join gives for their batches."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(join(left.to_batches(), right.to_batches()), pa.schema([("kept", left.schema.field("kept").type.value_type), ("ids", pa.binary())]))

    return run


def pieces(path: str) -> list[str]:
    """The vocabulary's piece of each id."""
    t = tokenizer(path).tokenizer
    return [t.id_to_token(i) or "" for i in range(max(t.get_vocab().values()) + 1)]


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of ids, special tokens included, as the library's decode() gives it.

    Without a decoder in the vocabulary's file that is the pieces with blanks between; other vocabularies ask the library.
    """
    kept = [c for c in rows.columns if c != ids]
    source = rows.select(F.struct(*kept).alias("kept"), F.col(ids).alias("ids")) if kept else rows.select(F.struct(F.lit(0).alias("none")).alias("kept"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path).tokenizer
        table = None if t.decoder else pa.array([p + " " for p in pieces(path)], pa.large_string()).cast(pa.large_binary())
        for b in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            numbers, ends = flat(b.column(1), "<u4")
            begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
            if table is None:
                texts = [t.decode(numbers[i:j].tolist(), skip_special_tokens=False) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
            else:
                taken = pc.take(table, pa.array(numbers))
                sizes = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
                data = memoryview(taken.buffers()[2] or b"")
                texts = [bytes(data[i : max(i, j - 1)]) for i, j in zip(sizes[begins].tolist(), sizes[ends].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string() if table is None else pa.binary()).cast(pa.string())], names=["kept", "ids", "decoded"])

    kept_type = source.schema["kept"].dataType.simpleString()
    out = source.mapInArrow(run, f"kept {kept_type}, ids binary, decoded string")
    return out.select(*(F.col("kept")[c].alias(c) for c in kept), F.col("ids").alias(ids), F.col("decoded").alias(into))


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
