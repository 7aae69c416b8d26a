"""Phrase collocations from vertical positional inverted lists.

1. Documents are dealt into blocks of some million words of a language. A block holds, for each word, the ascending list
   of its positions; a position is left free between two pieces, so nothing is adjacent across them. Blocks are written to
   the shared folder once.
2. Lists of phrases grow by one word a round: a phrase's positions, moved on by its length, are merge-joined with the
   postings of the words that stand there, if a phrase of the same length starts one word further on. A list's length is
   the phrase's number of occurrences in the block. Only (numbers of its words, length) is shuffled and summed.
3. Words are summed by text. A word's number is half of its hash; those that share it with another word are found among all
   words and have numbers of their own, so a phrase's numbers stand for its text and no hash decides a result.
4. A round's frequent phrases make a bit filter of a fixed size (FILTER_BITS), which the next round's tasks hold. It
   spares lists that cannot be frequent; those that pass wrongly cost work, never a result.
5. At last the texts of frequent phrases are joined from their words, each once.

Rows: a null text has no words, a null lang is `und`; rows that repeat an id or a text count again; an empty table gives an
empty one; texts are taken whole, one that is longer than a block is a block of its own; other columns are not looked at,
whatever their names. Equal scores and frequencies are ranked by phrase.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.llm.bpe import numbered, numbers_of, restored, squeezed
from bandwright.llm.common import FACTOR, mixed, run_dir, texts_of

#: Words after which blocks end with their document, and bits of the filter of frequent phrases.
BLOCK_WORDS, FILTER_BITS = 2_000_000, 1 << 26
#: Numbers from here on are given to words whose halves of hashes are alike.
OTHERS = (1 << 32) - (1 << 24)
#: Words of the longest phrase, its least frequency, rows of a language, and the share in percent at which a longer phrase stands for a shorter one.
LONGEST, LEAST, ROWS, SHARE = 4, 30, 2000, 80
#: Bytes that end a piece: of these, the point stands for all.
GAP = b"."
SEPARATORS = bytes.maketrans(b",;:!?\n\v\f\r", GAP * 9)


class Postings:
    """Words of one language's documents, numbered as they come; 0 is the gap between pieces."""

    def __init__(self):
        self.words: dict[bytes, int] = {GAP: 0}
        self.codes: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        found = text.lower().translate(SEPARATORS).replace(GAP, b" . ").split()
        words = self.words
        for w in set(found).difference(words):
            words[w] = len(words)
        self.codes += [np.fromiter(map(words.__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
        return len(found) + 1

    def lists(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, the lengths of their lists, and the lists behind each other."""
        codes = np.concatenate(self.codes)
        order = np.argsort(codes, kind="stable")
        lengths = np.bincount(codes, minlength=len(self.words))
        return list(self.words)[1:], lengths[1:], order[lengths[0] :]


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang", words_a_block: int = BLOCK_WORDS) -> DataFrame:
    """(lang, n, words, lengths, positions) in the shared folder: each block's words, how long their lists are, and the lists' steps."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))

    def row(own: str, postings: Postings) -> pa.RecordBatch:
        words, lengths, positions = postings.lists()
        steps = np.diff(positions, prepend=0)
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        steps[starts] = positions[starts]  # each list starts anew
        columns = [pa.array([own]), pa.array([int(lengths.sum())]), pa.array([words], pa.list_(pa.binary())), pa.array([numbered(lengths)], pa.binary()), pa.array([squeezed(numbered(steps))], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "n", "words", "lengths", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang, size = defaultdict(Postings), 0
        for b in batches:
            for own, raw in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                size += by_lang[own].add(raw)
                if size >= words_a_block:
                    for key in list(by_lang):
                        yield row(key, by_lang.pop(key))
                    size = 0
        for key in list(by_lang):
            yield row(key, by_lang.pop(key))

    folder = run_dir(docs.sparkSession, "postings")
    source.mapInArrow(run, "lang string, n long, words array<binary>, lengths binary, positions binary").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def places_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each key."""
    return keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)


def passing(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for place in places_of(keys, 64 * len(table)):
        out &= (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def keys_of(pairs: list[np.ndarray]) -> np.ndarray:
    """Keys of phrases of two words or more for the filter; pairs hold the numbers of two words each, a last one alone where the words are odd."""
    keys = mixed(pairs[0])
    for x in pairs[1:]:
        keys = mixed(keys * np.uint64(FACTOR) + x)
    return keys


def hashes_of(langs: list[str], words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, a language's by its own seed."""
    seeds = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    return mixed(np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[x]) for x, w in zip(langs, words, strict=True)), np.uint64, len(words)))


@dataclass
class Numbers:
    """Numbers of 32 bits, one for each word that passes the filter and no two alike: the upper half of its hash, but for the words that others gives one."""

    taken: np.ndarray
    others: dict[tuple[str, bytes], int]

    def of(self, langs: list[str], words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        out = hashes >> np.uint64(32)
        for i in np.flatnonzero((out >= OTHERS) | np.isin(out, self.taken)).tolist():
            out[i] = self.others.get((langs[i], words[i]), OTHERS)  # words that don't pass have none
        return out


@dataclass
class Lists:
    """Phrases of one length in a block: the numbers of their words by pairs, lengths of lists, and the lists behind each other."""

    pairs: list[np.ndarray]
    lengths: np.ndarray
    positions: np.ndarray

    def kept(self, chosen: np.ndarray) -> Lists:
        return Lists([x[chosen] for x in self.pairs], self.lengths[chosen], self.positions[np.repeat(chosen, self.lengths)])

    def extended(self, size: int, word_at: np.ndarray, numbers: np.ndarray) -> Lists:
        """The lists of phrases of size words, by one word more."""
        phrase = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts = np.zeros(len(word_at), bool)
        starts[self.positions] = True
        follower = word_at[self.positions + size]  # the posting that has the adjacent position
        met = (follower >= 0) & starts[self.positions + 1]
        pair = phrase[met] * len(numbers) + follower[met]
        order = np.argsort(pair, kind="stable")
        pair, positions = pair[order], self.positions[met][order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        parents, last = pair[first] // len(numbers), numbers[pair[first] % len(numbers)]
        pairs = [x[parents] for x in self.pairs]
        if size % 2:
            pairs[-1] = pairs[-1] << np.uint64(32) | last
        else:
            pairs.append(last)
        return Lists(pairs, np.diff(first, append=len(pair)), positions)


def grown(block: dict, size: int, table: np.ndarray, numbered_as: Numbers) -> Lists:
    """The block's lists of size words, at least two; shorter ones only where the filter lets them pass."""
    lengths, steps = numbers_of(block["lengths"]).astype(np.int64), numbers_of(restored(block["positions"])).astype(np.int64)
    sums = np.cumsum(steps)
    starts = np.cumsum(lengths) - lengths
    positions = sums - np.repeat(np.concatenate(([0], sums))[starts], lengths)
    langs = [block["lang"]] * len(block["words"])
    hashes = hashes_of(langs, block["words"])
    numbers = numbered_as.of(langs, block["words"], hashes)
    word_at = np.full((int(positions.max()) if len(positions) else 0) + size + 1, -1, np.int64)
    word_at[positions] = np.repeat(np.arange(len(lengths)), lengths)
    lists = Lists([numbers], lengths, positions).kept(passing(hashes, table))
    for k in range(1, size):
        if k > 1:
            lists = lists.kept(passing(keys_of(lists.pairs), table))
        lists = lists.extended(k, word_at, numbers)
    return lists


def vocabulary(found: DataFrame) -> DataFrame:
    """(lang, word, n, key) in the shared folder: each language's words, how often they occur, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, lengths in zip(b.column(0), b.column(1), b.column(2), strict=True):
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(words)), words.values, pa.array(numbers_of(lengths.as_py()).astype(np.int64))], names=["lang", "word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hashes_of(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.view(np.int64))], names=["lang", "word", "n", "key"])

    counts = found.select("lang", "words", "lengths").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    folder = run_dir(found.sparkSession, "words")
    counts.mapInArrow(hashed, "lang string, word binary, n long, key long").write.parquet(folder)
    return found.sparkSession.read.parquet(folder)


def numbers_for(words: DataFrame, table: Broadcast) -> Numbers:
    """Numbers for the words of vocabulary() that pass the filter. Only those whose halves of hashes are alike, or reserved, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(2).to_numpy().view(np.uint64)
            b = b.filter(pa.array(passing(keys, table.value)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((b.column(2).to_numpy().view(np.uint64) >> np.uint64(32)).view(np.int64))], names=["lang", "word", "half"])

    each = words.select("lang", "word", "key").mapInArrow(run, "lang string, word binary, half long")
    alike = each.groupBy("half").agg(F.count("*").alias("words")).where((F.col("words") > 1) | (F.col("half") >= OTHERS)).select("half")
    rows = each.join(alike, "half", "left_semi").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    if len(rows) >= (1 << 32) - OTHERS:
        raise ValueError("too many words for numbers of 32 bits")
    others = {key: OTHERS + 1 + i for i, key in enumerate(zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), strict=True))}
    return Numbers(np.unique(rows["half"].to_numpy()).astype(np.uint64), others)


def numbered_words(words: DataFrame, held: Broadcast, least: int) -> DataFrame:
    """(lang, word, n, number) of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(3).to_numpy().view(np.uint64)
            own = held.value.of(b.column(0).to_pylist(), b.column(1).to_pylist(), keys)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own.view(np.int64))], names=["lang", "word", "n", "number"])

    return words.where(F.col("n") >= least).mapInArrow(run, "lang string, word binary, n long, number long")


def counted(found: DataFrame, size: int, table: Broadcast, numbers: Broadcast) -> DataFrame:
    """(p0, p1, ..., n): each block's phrases of size words, at least two, by the numbers of their words, two in a column."""
    names = [*(f"p{i}" for i in range(-(-size // 2))), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            for k in range(block.num_rows):
                last = grown(block.slice(k, 1).to_pylist()[0], size, table.value, numbers.value)
                for at in range(0, len(last.lengths), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[part].view(np.int64)) for x in last.pairs), pa.array(last.lengths[part])], names=names)

    return found.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def keyed(rows: DataFrame) -> DataFrame:
    """(key) of phrases (p0, p1, ..., n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = keys_of([c.to_numpy().view(np.uint64) for c in x.columns])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return rows.drop("n").mapInArrow(run, "key long")


def marked(spark: SparkSession, frequent: DataFrame, before: np.ndarray | None, bits: int) -> np.ndarray:
    """The filter's words of 64 bits, those of frequent keys set besides those set before. At most bits / 64 rows come to the driver."""
    places = (F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))
    each = frequent.select(F.explode(F.array(*places)).alias("place"))
    rows = each.groupBy(F.shiftright("place", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64) if before is None else before.copy()
    table[rows["slot"].to_numpy()] |= rows["mask"].to_numpy().view(np.uint64)
    return table


def phrases(found: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, k, phrase, a) in the shared folder: all phrases of up to longest words that occur least times in their language, of blocks()."""
    spark, words = found.sparkSession, vocabulary(found)
    table = marked(spark, words.where(F.col("n") >= least).select("key"), None, bits)
    held = spark.sparkContext.broadcast(table)
    numbers = spark.sparkContext.broadcast(numbers_for(words, held))
    rounds = []
    for size in range(2, longest + 1):
        own = counted(found, size, held, numbers)
        sums = own.groupBy(*own.columns[:-1]).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        folder = run_dir(spark, "frequent")
        sums.write.parquet(folder)
        rounds.append(spark.read.parquet(folder))
        if size < longest:
            table = marked(spark, keyed(rounds[-1]), table, bits)
            held = spark.sparkContext.broadcast(table)
    folder = run_dir(spark, "phrases")
    written(rounds, numbered_words(words, numbers, least)).write.parquet(folder)
    return spark.read.parquet(folder)


def written(rounds: list[DataFrame], words: DataFrame) -> DataFrame:
    """(lang, k, phrase, a) of frequent words, and of phrases by their words' numbers; each text is made once."""
    out = words.select("lang", F.lit(1).alias("k"), F.col("word").cast("string").alias("phrase"), F.col("n").alias("a"))
    for size, rows in enumerate(rounds, 2):
        for i in range(size):
            pair = F.col(f"p{i // 2}")
            number = pair.bitwiseAND(F.lit((1 << 32) - 1)) if i % 2 or i == size - 1 else F.shiftrightunsigned(pair, 32)
            own = words.select(F.col("number").alias("number"), F.col("word").cast("string").alias(f"w{i}"), *(["lang"] if i == 0 else []))
            rows = rows.withColumn("number", number).join(own, "number").drop("number")
        out = out.unionByName(rows.select("lang", F.lit(size).alias("k"), F.concat_ws(" ", *(f"w{i}" for i in range(size))).alias("phrase"), F.col("n").alias("a")))
    return out


def exact(name: str):
    return F.col(name).cast("decimal(19,0)")


def scored(known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of the phrases of two words or more, by their worst cut."""
    parts = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = known.where("k > 1").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', c)"), "rest": F.expr("substring_index(phrase, ' ', c - k)")})
    met = cuts.join(parts.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"]).join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = met.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "c", "l", "r")).alias("cut"))
    return best.select("lang", "k", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(known: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest frequency of a longer phrase that holds it, for phrases of two words or more."""
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    return known.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, words_a_block: int = BLOCK_WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, frequency and text."""
    found = blocks(docs, text, lang, words_a_block)
    known = phrases(found, longest, least, bits)
    sizes = found.groupBy("lang").agg(F.sum("n").alias("n"))
    left = scored(known, longest).join(covered(known), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * exact("most") < share * exact("a")))
    best = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= rows)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) AS t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest FROM f, range(1, {LONGEST}) AS t(c) WHERE c < k),
s AS (SELECT c.*, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = head JOIN f AS r ON r.lang = c.lang AND r.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
i AS (SELECT lang, array_to_string(string_split(phrase, ' ')[x : x + m - 1], ' ') AS phrase, max(a) AS most FROM f, range(2, {LONGEST}) AS t(m), range(1, {LONGEST}) AS u(x) WHERE m < k AND x + m - 1 <= k GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < {SHARE} * b.a QUALIFY rank <= {ROWS}"""
