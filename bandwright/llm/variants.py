"""Groups of spelling variants: words that differ in one inserted, deleted or replaced code point, found by two-dimensional range reporting.

A word of n code points is a point: its rank in forward order and its rank in the order of reversed words. Words that come
from another by an edit at position i lie in a rectangle: the forward interval of the first i code points by the reverse
interval of those behind the edit. Wavelet trees over the points report the rectangles of all words and positions.

An edit in the first half leaves the second half as it is, and the other way round. So words meet in groups by their first
or their second half, and groups are put together into trees of some ten thousand words. A group of more than MOST_WORDS
words is parted by a code point more; of the edits at the position passed over, two words then share all but that code
point, by which they are joined: such a group has at most one word for each code point.

Rows: null texts have no words; a null doc_id counts as an empty one; rows that repeat an id count again; an empty table
gives an empty one; texts are taken whole and words may be of any length; other columns are not looked at, whatever their
names. Equal numbers are decided by code-point order.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import cut, texts_of
from bandwright.llm.wavelet import WaveletTree

RUN = re.compile("[a-zÀ-ÿ]+")
#: Least code points and occurrences of a word, the divisor of the runs that lose a code point, and how many times a form is more frequent.
LEAST_LENGTH, LEAST, LOSES, TIMES = 6, 5, 199, 5
#: Words of a group above which it is parted, and words of a tree at which it takes no further group.
MOST_WORDS, TREE_WORDS = 100_000, 50_000
ROWS_AT_ONCE = 1 << 16


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): runs of letters, lower-cased in A-Z, some of them with a code point less, and how often they occur in some documents."""
    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(RUN.findall(raw.lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % LOSES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) >= 4 * ROWS_AT_ONCE:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return source.mapInArrow(run, "word string, n long")


def words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): the distinct words of at least least occurrences."""
    return runs(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def intervals(rank: np.ndarray, texts: list[str], order: list[int], breaks: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For i = 0, 1, ..: (i, indexes, first, last) with the range of places in order that share the first i characters with each text wanted so far.

    order sorts texts within groups, which start at breaks; rank is each text's place. wanted is the largest i for each text.
    """
    n = len(order)
    shared = np.zeros(n, np.int64)
    for p in range(1, n):
        a, b = texts[order[p - 1]], texts[order[p]]
        k, stop = 0, min(len(a), len(b))
        while k < stop and a[k] == b[k]:
            k += 1
        shared[p] = k
    shared[breaks] = -1
    for i in range(int(wanted.max(initial=-1)) + 1):
        own = np.flatnonzero(wanted >= i)
        starts = np.flatnonzero(shared < i)
        group = np.searchsorted(starts, rank[own], side="right") - 1
        yield i, own, starts[group], np.append(starts, n)[group + 1]


def near_in(groups: np.ndarray, texts: list[str], base: np.ndarray, forward: np.ndarray, fixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, near word) by index, both ways: words of one group, of which those of base code points ask and those of base + 1 are asked too.

    forward tells whether a group shares its first code points, fixed how many; edits lie behind them. Otherwise it shares its last ones.
    """
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    back = [t[::-1] for t in texts]
    ranks, orders, breaks = [], [], []
    for own in (texts, back):
        order = sorted(range(n), key=lambda i: (groups[i], own[i]))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        orders.append(order)
        breaks.append(np.flatnonzero(np.diff(groups[order], prepend=-1)))
    asks = sizes == base
    classes = []  # words of base code points, words of one more: their ranks among themselves, and the tree
    for chosen in (asks, ~asks):
        below = [np.concatenate(([0], np.cumsum(chosen[order]))) for order in orders]
        members = np.array(orders[0], np.int64)[chosen[orders[0]]]
        by_back = np.array(orders[1], np.int64)[chosen[orders[1]]]
        classes.append((below, by_back, WaveletTree(below[1][ranks[1][members]])))
    # Position i of a word of base code points: i code points before it, and behind it base - i - 1 if one is replaced, base - i if one comes in.
    first_end = np.where(forward, base, base - fixed)  # edits at positions before this (replace), up to it (insert) on the forward side
    first = np.where(forward, fixed, 0)
    prefix_most = np.where(asks, np.where(forward, base, first_end - 1), -1)
    suffix_most = np.where(asks, base - first, -1)
    prefixes = {i: (own, a, b) for i, own, a, b in intervals(ranks[0], texts, orders[0], breaks[0], prefix_most)}
    suffixes = list(intervals(ranks[1], back, orders[1], breaks[1], suffix_most))
    for inserted in (False, True):
        below, by_back, tree = classes[inserted]
        if not tree.size:
            continue
        for k, own, c, d in suffixes:  # k code points behind the edit
            at = base[own] - k - (0 if inserted else 1)
            fits = (at >= first[own]) & (at < np.where(forward[own], base[own] + inserted, first_end[own]))
            asked, at, c, d = own[fits], at[fits], c[fits], d[fits]
            if not len(asked):
                continue
            a, b = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
            for i in np.unique(at).tolist():
                members, low, high = prefixes[i]
                here = np.flatnonzero(at == i)
                place = np.searchsorted(members, asked[here])
                a[here], b[here] = low[place], high[place]
            if not inserted:
                wide = (b - a > 1) & (d - c > 1)  # else only the word itself is there
                asked, at, a, b, c, d = (x[wide] for x in (asked, at, a, b, c, d))
            query, y = tree.report(below[0][a], below[0][b], below[1][c], below[1][d])
            word, other = asked[query], by_back[y]
            if inserted:  # of equal neighbours the first came in, so a pair is met once
                met = np.fromiter((i == 0 or texts[o][i] != texts[o][i - 1] for i, o in zip(at[query].tolist(), other.tolist(), strict=True)), bool, len(other))
                yield word[met], other[met]
                yield other[met], word[met]
            else:
                yield word[word != other], other[word != other]


def members(found: DataFrame) -> DataFrame:
    """(base, forward, fixed, shared, word, n): each word in the groups of its own length and of one code point less, by first and second half."""
    size = F.length("word")
    rows = found.select("word", "n", F.explode(F.array(size, size - 1)).alias("base"))
    half = F.floor(F.col("base") / 2).cast("int")
    sides = F.array(F.struct(F.lit(True).alias("forward"), half.alias("fixed")), F.struct(F.lit(False).alias("forward"), (F.col("base") - half).alias("fixed")))
    return rows.select("word", "n", "base", F.explode(sides).alias("s")).select("word", "n", "base", "s.forward", "s.fixed").withColumn("shared", shared(F.col("fixed")))


def shared(fixed: Column) -> Column:
    return F.when(F.col("forward"), F.expr("substring(word, 1, fixed)")).otherwise(F.expr("right(word, fixed)"))


def report(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n) within the groups of members()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(chunk: list[tuple]) -> Iterator[pa.RecordBatch]:
            base, forward, fixed, _, texts, n = zip(*chunk, strict=True)
            keys = [c[:4] for c in chunk]
            groups = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
            counts = np.array(n, np.int64)
            names = pa.array(texts, pa.string())
            for word, near in near_in(groups, list(texts), np.array(base, np.int64), np.array(forward, bool), np.array(fixed, np.int64)):
                for at in range(0, len(word), ROWS_AT_ONCE):
                    w, o = word[at : at + ROWS_AT_ONCE], near[at : at + ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(w)), pa.array(counts[w]), names.take(pa.array(o)), pa.array(counts[o])], names=["word", "n", "near", "near_n"])

        chunk: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if len(chunk) >= TREE_WORDS and chunk[-1][:4] != row[:4]:
                    yield from found(chunk)
                    chunk = []
                chunk.append(row)
        if chunk:
            yield from found(chunk)

    key = ["base", "forward", "fixed", "shared"]
    return rows.select(*key, "word", "n").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "word string, n long, near string, near_n long")


def near_words(found: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, near, near_n): every two near words of (word, n), both ways, each once."""
    rows, parts = members(found), []
    key = ["base", "forward", "fixed", "shared"]
    while True:
        large = cut(rows.groupBy(*key).count().where(F.col("count") > most).select(*key))
        if large.isEmpty():
            return union([*parts, report(rows)])
        hot = cut(rows.join(large, key, "left_semi"))
        parts.append(report(rows.join(large, key, "left_anti")))
        parts.append(by_position(hot))
        rows = hot.withColumn("fixed", F.col("fixed") + 1).withColumn("shared", shared(F.col("fixed")))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_position(hot: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of edits right at the code point by which a large group is parted: words that agree in all others."""
    position = F.when(F.col("forward"), F.col("fixed")).otherwise(F.col("base") - F.col("fixed") - 1)  # of the code point replaced, or before which one comes in
    asks = F.length("word") == F.col("base")
    rows = hot.withColumn("at", position).where((F.col("at") >= 0) & (F.col("at") <= F.col("base")))
    without = lambda at: F.concat(F.expr(f"substring(word, 1, {at})"), F.expr(f"substring(word, {at} + 2)"))
    key = ["base", "forward", "fixed", "rest"]
    equal = rows.where(asks & (F.col("at") < F.col("base"))).withColumn("rest", without("at")).select(*key, "word", "n")
    other = equal.select(*key, F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = equal.join(other, key).where("word <> near").select("word", "n", "near", "near_n")
    short = rows.where(asks).withColumn("rest", F.col("word")).select(*key, "word", "n")
    doubled = F.expr("at > 0 and substring(word, at + 1, 1) = substring(word, at, 1)")  # the first of equal neighbours came in
    long = rows.where(~asks & ~doubled).withColumn("rest", without("at")).select(*key, F.col("word").alias("near"), F.col("n").alias("near_n"))
    inserted = short.join(long, key).select("word", "n", "near", "near_n")
    turned = inserted.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return union([replaced, inserted, turned])


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root): each word's near words counted, the form it is a variant of, and the form that has none.

    Forms grow by times at least, so a chain has at most log(largest n) / log(times) links; roots are found by doubling.
    """
    found = cut(words(docs, least))
    best = near_words(found, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    large = F.col("near_n").cast("decimal(38,0)") >= F.col("n").cast("decimal(30,0)") * times
    rows = cut(rows.select("word", "n", "n_near", F.when(large, F.col("near")).alias("form"), F.when(large, F.col("near_n")).alias("form_n")))
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    links = max(1.0, math.log(max(2, rows.agg(F.max("n")).first()[0] or 2), max(2, times)))
    for _ in range(math.ceil(math.log2(links)) + 1):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: crc32 as DuckDB can say it: a table of bytes, and one step for each byte of a text.
ORACLE = rf"""
WITH RECURSIVE bits AS (SELECT i AS b, i AS c, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
e AS (SELECT id, r, count(*) AS n FROM d WHERE length(r) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT r, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(regexp_replace(hex(encode(id || ':' || r)), '(..)', '\1 ', 'g')[:-2], ' '), lambda x: CAST(strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17 AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM e, crc),
w AS (SELECT CASE WHEN h % {LOSES} = 0 THEN r[: h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST}),
x AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM v, range(1, 10000) AS t(i) WHERE i <= length(word)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x AS a JOIN x AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = rest UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = rest),
q AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * n THEN near END AS form, CASE WHEN most >= {TIMES} * n THEN most END AS form_n FROM v LEFT JOIN q USING (word)),
walk AS (SELECT word, word AS node, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.form)
SELECT word, n, n_near, f.form, form_n, node AS root FROM f JOIN walk USING (word) WHERE walk.form IS NULL"""
