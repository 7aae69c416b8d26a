"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. In any alignment at THRESHOLD at least (4 * THRESHOLD - 1) / 3 of the item's word bigrams less one stand in the document
   side by side or with one word put in between (`kept_grams`). So the most frequent bigrams of an item (by the items that
   hold them), as many as half of those it keeps, need no look: its rare ones are the seeds, and a document must hold the
   other half among its own bigrams and its pairs over one word. Longer seeds would miss evenly edited copies.
2. A document's seeds fetch the items that hold them; around the shared bigrams' diagonal the item is aligned to the
   document word by word. The score is divided by the item's score against itself, and at THRESHOLD the passage counts as a leak.
The items are read in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import all_but, batch, cut, fresh, grams, texts_of
from bandwright.llm.passages import plain_hashes

N = 2
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.45
#: Characters of test items that one block holds at most in expectation; blocks are broadcast as arrays of some 30 bytes a word.
BLOCK_CHARS = 32 << 20
#: The low bits of a hash that a first, coarse membership test looks up.
COARSE = 20


def kept_grams(size: np.ndarray | int, threshold: float) -> np.ndarray:
    """Of an item of size words the least number of its bigrams that a copy at threshold keeps, side by side or over one word.

    With m matched words the gaps and mismatches cost 2 * m - 2 * threshold * size at most. A bigram is lost for one of
    these where an inner word is replaced or left out, and for two where words are put in. With u inner words replaced or
    left out m = size - u, so that least is kept where all edits are of that kind: u = (2 - 2 * threshold) / 3 * size.
    """
    return np.maximum(1, np.ceil((4 * threshold - 1) / 3 * size - 1 - 1e-9)).astype(np.int64)


class Items:
    """Test items of one block as arrays: their words, and their seeds sorted by hash."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        words = [(i, plain_hashes((text or "").encode())) for i, text in rows]
        words = [(i, w) for i, w in words if len(w)]
        self.ids = np.array([i for i, _ in words], np.int64)
        self.sizes = np.array([len(w) for _, w in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = np.concatenate([w for _, w in words]) if words else np.empty(0, np.uint64)
        self.seeds = {}
        for n in sorted({min(N, int(k)) for k in self.sizes}):
            own = np.flatnonzero(np.minimum(self.sizes, N) == n)
            each = [grams(self.of(i), n) for i in own]
            item, key = np.repeat(own, [len(g) for g in each]), np.concatenate(each)
            # each item's bigrams from rare to frequent, by the items that hold them
            pairs = np.unique(np.stack((key, item.astype(np.uint64))), axis=1)[0]
            hashes, held = np.unique(pairs, return_counts=True)
            order = np.lexsort((key, held[np.searchsorted(hashes, key)], item))
            rank = np.arange(len(order)) - np.repeat(np.cumsum([0, *(len(g) for g in each)])[:-1], [len(g) for g in each])
            place = order - np.repeat(np.cumsum([0, *(len(g) for g in each)])[:-1], [len(g) for g in each])
            least = kept_grams(self.sizes, threshold)
            use = rank < (self.sizes - n + 1 - least + -(-least // 2))[item[order]]
            order, place = order[use], place[use]
            by_key = np.argsort(key[order], kind="stable")
            self.seeds[n] = Seeds(key[order][by_key], item[order][by_key].astype(np.int32), place[by_key].astype(np.int32))
        #: distinct seeds that a document must share
        self.least = -(-kept_grams(self.sizes, threshold) // 2)

    def of(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i + 1]]


def met_grams(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, places, how many of them are plain) of a document's n-grams, for n = 2 the pairs over one word behind them."""
    plain = grams(words, n)
    if n != 2 or len(words) < 3:
        return plain, np.arange(len(plain)), len(plain)
    even, odd = grams(words[::2], 2), grams(words[1::2], 2)
    over = np.empty(len(even) + len(odd), np.uint64)
    over[::2], over[1::2] = even, odd
    return np.concatenate((plain, over)), np.concatenate((np.arange(len(plain)), np.arange(len(over)))), len(plain)


class Seeds:
    """(hash, item, place) sorted by hash, with a coarse bitmap in front."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.all, self.first, self.count = np.unique(keys, return_index=True, return_counts=True)
        self.item, self.place = item, place
        self.coarse = np.zeros(1 << COARSE, bool)
        self.coarse[(self.all & np.uint64((1 << COARSE) - 1)).astype(np.int64)] = True

    def met(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of each seed among the hashes g."""
        g = np.unique(g[self.coarse[(g & np.uint64((1 << COARSE) - 1)).astype(np.int64)]])
        near = np.minimum(np.searchsorted(self.all, g), len(self.all) - 1)
        near = near[self.all[near] == g]
        count = self.count[near]
        at = np.repeat(self.first[near] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.item[at], self.place[at]


def row_after(above: np.ndarray, text: np.ndarray, word: np.uint64, places: np.ndarray, floor: int | None) -> np.ndarray:
    """The next row of an alignment table; without a floor its first column is a gap."""
    cell = np.empty_like(above)
    cell[0] = 0 if floor is not None else above[0] + GAP
    cell[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
    if floor is not None:
        np.maximum(cell, floor, out=cell)
    return np.maximum.accumulate(cell + places) - places


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, stop) of the best local alignment; start and stop in text. Linear gaps.

    Only one row is held: the end comes from the rows' maxima, the start from aligning backwards from the end.
    """
    places = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    row, best, end, stop = np.zeros(len(text) + 1, np.int32), 0, 0, 0
    for i, word in enumerate(item):
        row = row_after(row, text, word, places, 0)
        if (j := int(row.argmax())) and row[j] > best:
            best, end, stop = int(row[j]), i + 1, j
    if not best:
        return 0, 0, 0
    back, row = text[:stop][::-1], -places[: stop + 1]
    for word in item[:end][::-1]:
        row = row_after(row, back, word, places[: stop + 1], None)
        if row.max() >= best:
            return best, stop - int(row.argmax()), stop
    return best, 0, stop


def regions(hits: list[tuple[int, int]], size: int, length: int, slack: int) -> Iterator[tuple[int, int]]:
    """Parts of a document of length words that may hold an item of size words, from its bigrams (place, place in the item).

    slack: words that an alignment may put in or leave out.
    """
    start = stop = None
    for place, own in sorted(hits, key=lambda h: h[0] - h[1]):
        a, b = max(0, place - own - slack), min(length, place - own + size + slack)
        if start is not None and a <= stop:
            stop = max(stop, b)
            continue
        if start is not None:
            yield start, stop
        start, stop = a, b
    if start is not None:
        yield start, stop


def leaks_of(words: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(item_id, start, stop, score) of each passage of a document that an item aligns to."""
    known = None
    for n, seeds in items.seeds.items():
        g, places, plain = met_grams(words, n)
        item, _ = seeds.met(g)
        if not len(item):
            continue
        found, shared = np.unique(item, return_counts=True)
        found = found[shared >= items.least[found]]
        if not len(found):
            continue
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        known = np.unique(words) if known is None else known
        for i in found.tolist():
            own = items.of(i)
            size = len(own)
            mine = grams(own, n)
            low, high = np.searchsorted(sorted_g, mine), np.searchsorted(sorted_g, mine, "right")
            # Of m matched words all but those that a gap or mismatch follows begin a shared bigram, and each of these costs 1 at
            # least: MATCH * m - (m - 1 - shared) reaches the threshold only if m + shared + 1 does. So it may be said of the whole
            # document first.
            there = np.isin(own, known)
            enough = lambda inside, shared: inside >= max(threshold * size, MATCH * threshold * size - 1 - shared) - 1e-9  # noqa: E731, B023
            if not enough(int(there.sum()), int((high > low).sum()) if size >= N else size):
                continue
            count = high - low
            hit = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            by = np.repeat(np.arange(len(mine)), count)
            side_by_side = hit < plain
            shared = len(np.unique(by[side_by_side])) if size >= N else size
            if not enough(int(there.sum()), shared):
                continue
            at = places[hit]
            todo = list(regions(list(zip(at.tolist(), by.tolist(), strict=True)), size, len(words), int(2 * (1 - threshold) * size) + 1))
            at, by = at[side_by_side], by[side_by_side]
            while todo:
                a, b = todo.pop()
                part = words[a:b]
                # No alignment scores more than MATCH for each word that occurs there at all.
                if not enough(int(np.isin(own, part).sum()), len(np.unique(by[(at >= a) & (at < b)])) if size >= N else size):
                    continue
                score, start, stop = smith_waterman(own, part)
                score /= MATCH * size
                if score >= threshold:
                    yield int(items.ids[i]), a + start, a + stop, round(score, 6)
                    todo += [(x, y) for x, y in ((a, a + start), (a + stop, b)) if y > x]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, stop, score) of each passage of docs (doc_id, text) that copies an item (item_id, text).

    Places count words other than bare punctuation. Null or empty texts and items, and items without an id, leak nothing;
    items shorter than N words are sought whole. Repeated rows of docs repeat their result, repeated items do not. A null
    doc_id stays null in the result. Very long texts and items are aligned whole, row by row. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates(["item_id"])
    blocks = 1 + int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    names = ("doc_id", "item_id", "start", "stop", "score")
    schema = pa.schema([(n, pa.float64() if n == "score" else pa.int64()) for n in names])
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, stop long, score double")
    for k in range(blocks):
        block = Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()], threshold)  # of bounded size
        if not len(block.ids):
            continue
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                    rows += [(doc_id, *x) for x in leaks_of(plain_hashes(text), own, threshold)]
                if rows:
                    yield batch(schema, **dict(zip(names, zip(*rows, strict=True), strict=True)))

        found = docs.mapInArrow(run, "doc_id long, item_id long, start long, stop long, score double")
        out = found if blocks == 1 else out.union(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a leak; all columns stay, whatever their names. Rows that share a leaking id go together."""
    leaking_id = fresh(docs, "leaking_id")
    leaking = cut(leaks(docs, items, threshold).select(F.col("doc_id").alias(leaking_id)).distinct())
    return all_but(docs, leaking, F.col("doc_id").eqNullSafe(F.col(leaking_id)))
