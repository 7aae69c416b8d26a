"""MinHash near-duplicate classes from HyperMinHash sketches.

A document's set holds its distinct word shingles. The set's 64-bit hashes fall into 2**p buckets; a bucket keeps,
of its smallest hash, the count of leading zeros and a few mantissa bits (16 bits instead of 64). Empty buckets borrow
from others by a fixed random sequence, so small sets fill all registers too.

1. Equal sets form a class; one member stands for it.
2. Bands of registers give bucket keys. Each member of a bucket is paired with the bucket's smallest id, never with all.
3. The Jaccard estimate of the registers, corrected for chance collisions, drops pairs ERRORS standard errors below the
   threshold; only then texts are fetched, and exact intersections of the full sets confirm the rest. A leader's text goes
   once to each CHUNK of its members.
4. Connected components of the confirmed links (large star, small star).
5. Buckets that still hold several components go through an exact prefix-filter join, restricted to pairs of different
   components. So a star never hides a link, and no bucket needs a cap.

What the method itself can miss: two sets at Jaccard 0.8 share none of the BANDS bands with a chance of about 3e-6, and
the estimate of a true pair lies ERRORS standard errors too low with about 3e-7 (tests measure both on many pairs).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.llm.common import all_but, batch, cut, grams, mixed, only, texts_of, word_hashes

#: Members of a leader that are confirmed together, and a token's members of a side that meet in one part.
CHUNK, MEET = 256, 512
P, MANTISSA, ROWS = 8, 10, 6
REGISTERS = 1 << P
BANDS = REGISTERS // ROWS
#: Two unequal minima agree on the leading zeros with 1/3 and on the mantissa with 2**-MANTISSA.
COLLISION = 1 / 3 / (1 << MANTISSA)
#: Standard errors below the threshold at which an estimate still goes on to the exact check.
ERRORS = 5.0
TRIES = 64


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, a text without words none."""
    h = word_hashes(text.lower())
    return np.unique(grams(h, min(words, len(h)))) if len(h) else h


def borrow_from(attempt: int, registers: np.ndarray) -> np.ndarray:
    """Buckets that empty registers try in the attempts from this one on, a row for each attempt."""
    tries = np.arange(attempt, attempt + TRIES, dtype=np.uint64)[:, None]
    return (mixed(registers.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + tries * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(REGISTERS - 1)).astype(np.int64)


FIRST_TRIES = borrow_from(0, np.arange(REGISTERS))


def hyperminhash(shingles: np.ndarray) -> bytes:
    """Registers of a sorted, non-empty set of 64-bit hashes as little-endian 16-bit numbers."""
    bucket = (shingles >> np.uint64(64 - P)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    rest = shingles[first] << np.uint64(P)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    registers, full = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    registers[bucket[first]] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    full[bucket[first]] = True
    empty, attempt, own = np.flatnonzero(~full), 0, registers.copy()
    while len(empty):
        source = FIRST_TRIES[:, empty] if attempt == 0 else borrow_from(attempt, empty)
        hit = full[source]
        found = hit.any(axis=0)
        at = hit.argmax(axis=0)
        registers[empty[found]] = own[source[at[found], np.flatnonzero(found)]]
        empty, attempt = empty[~found], attempt + TRIES
    return registers.astype("<u2").tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sketch) of every row; set_hash and sketch are null for the empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, signs, marks = [], [], []
            for text in texts_of(b.column(1)):
                s = shingle_set(text, words)
                sizes.append(len(s))
                signs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                marks.append(hyperminhash(s) if len(s) else None)
            yield batch(schema, doc_id=b.column(0), n_shingles=sizes, set_hash=signs, sketch=marks)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sketch binary")


def estimated(a: np.ndarray, b: np.ndarray) -> float:
    """Collision-corrected Jaccard estimate of two sketches' registers."""
    return (float(np.mean(a == b)) - COLLISION) / (1 - COLLISION)


def least_estimate(percent: int, registers: int) -> float:
    """Estimates below this mean a Jaccard similarity below percent."""
    share = percent / 100
    return share - ERRORS * (share * (1 - share) / registers) ** 0.5


def likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity. marks: (doc_id, n_shingles, sketch)."""
    side = lambda k: marks.select(*(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "sketch", "n_shingles")))
    smaller, larger = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    met = pairs.join(side("a"), F.col("a") == F.col("doc_id_a")).join(side("b"), F.col("b") == F.col("doc_id_b")).where(smaller * 100 >= larger * percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_ in batches:
            left, right = [], []
            for x, y, sx, sy, n in zip(*(batch_.column(i).to_pylist() for i in range(5)), strict=True):
                if estimated(np.frombuffer(sx, "<u2"), np.frombuffer(sy, "<u2")) >= least_estimate(percent, min(n, REGISTERS)):
                    left.append(x)
                    right.append(y)
            yield batch(schema, a=left, b=right)

    return met.select("a", "b", "sketch_a", "sketch_b", smaller.alias("n")).mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: (doc_id, text), one for each id."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts")).withColumnRenamed("a", "its_a")
    dealt = pairs.join(sizes, F.col("a") == F.col("its_a")).select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    members = dealt.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch_ in batches:
            left, right = [], []
            for x, y, text in zip(batch_.column(0).to_pylist(), batch_.column(2).to_pylist(), texts_of(batch_.column(3)), strict=True):
                own = shingle_set(text, words)
                if y is None:
                    head = own
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both * 100 >= percent * (len(head) + len(own) - both):
                    left.append(x)
                    right.append(y)
            yield batch(schema, a=left, b=right)

    return heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component. Alternates large and small stars."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()
        seen = sign
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        e = cut(small.distinct())


def set_tokens(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, tokens) with the full shingle sets as arrays, for the exact join."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, doc_id=b.column(0), tokens=[shingle_set(t, words).view(np.int64) for t in texts_of(b.column(1))])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<long>")


def prefix_pairs(texts: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Exact candidates between different components: two sets at the threshold share one of the rarest tokens of each.

    Of a set of n the n - ceil(percent * n / 100) + 1 rarest tokens (over these texts) are kept. For each token, members
    outside its largest component meet all members of other components, but only where the tokens from this one on can
    still make up the overlap that the two sizes ask for: the first common token of a true pair always passes.
    """
    t = set_tokens(texts, words).select("doc_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = t.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "token"))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = t.join(df.where("df > 1"), "token", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", rank).where(F.col("rank") <= keep).where("df > 1")
    kept = cut(kept.select("doc_id", "token", "n", (F.col("n") - F.col("rank") + 1).alias("rest")).join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    sizes = kept.groupBy("token", "root").agg(F.count("*").alias("size"))
    mixed_tokens = sizes.groupBy("token").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    # Sets whose sizes differ by less than the threshold's ratio stand in the same step or in neighbouring ones.
    step = F.floor(F.log("n") / F.lit(1.000001 * max(1e-7, math.log(100 / percent)))).cast("int")
    inside = cut(kept.join(mixed_tokens, "token").withColumn("step", step))
    columns = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "root", "n", "rest")]
    u = inside.where("root <> main").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).select("token", "step", *columns("a"))
    v = inside.select("token", "step", *columns("b"))
    # A token's members meet in parts of MEET a side, so that no task holds a frequent token alone.
    count = lambda side, name: side.groupBy("token", "step").agg(F.ceil(F.count("*") / MEET).cast("int").alias(name))
    parts = cut(count(u, "parts_a").join(count(v, "parts_b"), ["token", "step"]))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    u = u.join(parts, ["token", "step"]).withColumn("part_a", own("doc_id_a", "parts_a")).withColumn("part_b", every("parts_b")).drop("parts_a", "parts_b")
    v = v.join(parts, ["token", "step"]).withColumn("part_b", own("doc_id_b", "parts_b")).withColumn("part_a", every("parts_a")).drop("parts_a", "parts_b")
    # intersection >= percent / (100 + percent) * (n_a + n_b)
    possible = F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    met = u.join(v, ["token", "step", "part_a", "part_b"]).where((F.col("root_a") != F.col("root_b")) & possible)
    return met.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Links join documents whose shingle sets have 100 * intersection >= percent * union. Null or empty texts have no set
    and stand alone. A row with a null id stands alone too: component_id null, kept. Rows that repeat an id share its
    component; of their texts one is compared. Very long texts are compared whole. Other columns are ignored.
    """
    all_sets = cut(sketches(docs, words))
    full = all_sets.where("set_hash is not null and doc_id is not null")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    classes = cut(classes)
    reps = only(full, classes.select(F.col("class_id").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"]).select("doc_id", "n_shingles", "sketch")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = reps.select("doc_id", F.explode(keys).alias("key"))
    leaders = bands.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = cut(bands.join(leaders, "key"))
    pairs = shared.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    members = cut(shared.select("doc_id").distinct())
    marks = cut(only(reps, members).dropDuplicates(["doc_id"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = cut(likely(pairs, marks, percent))
        ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        return confirmed(pairs, cut(only(texts, ids).dropDuplicates(["doc_id"])), words, percent)

    links = cut(checked(pairs))
    roots = components(links)
    placed = shared.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ids = cut(placed.join(split, "key", "left_semi").select("doc_id").distinct())
    if not open_ids.isEmpty():
        more = checked(prefix_pairs(only(texts, open_ids).dropDuplicates(["doc_id"]), roots, words, percent))
        roots = components(links.union(more))
    by_class = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_hash", F.coalesce("root", "class_id").alias("component_id"))
    out = all_sets.drop("sketch").join(by_class, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate class, the one with the least id; all columns stay.

    Rows without words or without an id stay. Rows that repeat an id share its fate.
    """
    gone = cut(near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct())
    return all_but(docs, gone)
