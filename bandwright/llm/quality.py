"""Quality rules: base counts of each text, and cross-document line frequency by host. DataFrame functions only.

A line is normalised (lower case, digit runs as 0, white space runs as one blank, trimmed) and hashed. For each host the
distinct documents of a line are counted; documents whose normalised lines are the same in the same order are copies and count
once, so that a group of copies does not make its own lines boilerplate. Lines in more than max_docs documents of a host are removed from that
host's documents, and documents that lose more than max_removed of their line characters are rejected. Texts are read
once: counts and line hashes are written, and everything after works on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import BROADCAST_KEYS, WORD, cut, fresh

SPACES = r"[\x20\x09-\x0D]+"
MAX_DOCS = 10
MAX_REMOVED = 0.7
#: Parts that a frequent line's documents are dealt to where frequent lines are too many to broadcast.
SALTS = 32
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normalised(text: Column) -> Column:
    """The whole text at once; line ends stay."""
    text = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    text = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")
    return text


def line_hashes(text: Column) -> Column:
    """Of every line in order; null for lines without a word."""
    return F.transform(F.split(normalised(text), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def full_lines(text: Column) -> Column:
    """(hash, size) of every line with a word, in order."""
    each = F.transform(F.split(normalised(text), "\n"), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("hash"), F.length(F.trim(x)).alias("size")))
    return F.filter(each, lambda x: x["size"] > 0)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, counted in the column body."""
    as_they_are = F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD))
    docs = docs.withColumns({"words": F.array_remove(F.split("body", SPACES), ""), "as_they_are": as_they_are})
    n = F.size("words").cast("long")
    docs = docs.withColumns({
        "n_words": n, "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_symbols": F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("as_they_are") - F.size(F.array_distinct("as_they_are"))).cast("long"), "bits": F.ceil(F.log2(n + 1)).cast("int"),
    }).drop("as_they_are")
    # A window's hash in the high bits and its place in the low ones: sorting brings equal windows together.
    word = lambda i: F.get(F.col("words"), i)
    code = lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col("bits")).bitwiseOR(i.cast("long"))
    docs = docs.withColumn("codes", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), code))))
    high = lambda c: F.call_function("shiftright", c, F.col("bits"))
    either = lambda array, key, c, j: F.coalesce(key(F.get(array, j + 1)) == key(c), F.lit(False)) | F.coalesce(key(F.get(array, j - 1)) == key(c), F.lit(False))
    place = lambda c: c.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    docs = docs.withColumn("places", F.transform(F.filter("codes", lambda c, j: either("codes", high, c, j)), place)).drop("codes")
    # Where hashes meet the words themselves decide.
    window = lambda p: F.struct(F.concat_ws("\n", word(p), word(p + 1), word(p + 2)).alias("words"), p.alias("place"))
    docs = docs.withColumn("windows", F.sort_array(F.transform("places", window))).drop("words", "places")
    same = F.filter("windows", lambda c, j: either("windows", lambda x: x["words"], c, j))
    docs = docs.withColumn("places", F.sort_array(F.transform(same, lambda x: x["place"]))).drop("windows")
    covered = F.transform("places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1) - p, F.lit(3))).cast("long"))
    return docs.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("places", "bits")


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(host, hash) of lines in more than max_docs distinct documents of the host. lines: (host, copy, hash), copy naming a document's normalised text."""
    return lines.select("host", "hash", "copy").distinct().groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).drop("docs")


def verdicts(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """(doc_id, counts, base_failed, kept, removed_chars, removed) for every row of docs (doc_id, text, host column).

    removed: hashes of the row's lines that are above the limit. Null texts count as empty and fail the base; a null host
    is a host of its own; repeated rows are judged each, and count once for a line's frequency as copies. Very long texts
    are judged whole. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    each = base_counts(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("lines", full_lines(F.col("body")))).drop("body")
    each = cut(each.withColumns({"host": F.xxhash64("host"), "copy": F.xxhash64(F.transform("lines", lambda x: x["hash"]))}))
    by_line = each.select("row", "host", "copy", F.explode("lines").alias("line")).select("row", "host", "copy", F.col("line.hash").alias("hash"), F.col("line.size").alias("size"))
    often = cut(frequent_lines(by_line, max_docs)).select(F.col("host").alias("often_host"), F.col("hash").alias("often"))
    few = often.count() <= BROADCAST_KEYS
    salt, salts = (F.lit(0), F.array(F.lit(0))) if few else (F.pmod(F.col("row"), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    often = often.withColumn("its_salt", F.explode(salts))
    met = by_line.withColumn("salt", salt).join(F.broadcast(often) if few else often, (F.col("host") == F.col("often_host")) & (F.col("hash") == F.col("often")) & (F.col("salt") == F.col("its_salt")))
    gone = met.groupBy(F.col("row").alias("its_row")).agg(F.sum("size").alias("gone"), F.collect_set("often").alias("removed"))
    by_row = each.join(gone, F.col("row") == F.col("its_row"), "left")
    lost, chars = F.coalesce("gone", F.lit(0)), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return by_row.select(
        "doc_id", *STATS, failed.alias("base_failed"), (~failed & (lost * 1.0 <= chars * max_removed)).alias("kept"), lost.cast("long").alias("removed_chars"),
        F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of docs with their frequent lines removed from text; all other columns as they are.

    Rows that repeat a doc_id share what either of them was judged: they stay if one of them is kept. A null text fails.
    Columns may have any names.
    """
    judged_id, removed = fresh(docs, "judged_id"), fresh(docs, "judged_removed")
    judged = verdicts(docs, **limits).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed")).where("kept").select(F.col("doc_id").alias(judged_id), F.col("removed").alias(removed))
    joined = docs.join(judged, F.col("doc_id").eqNullSafe(F.col(judged_id)))
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), line_hashes(F.col("text")).alias("hash"))
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(removed, x["hash"]), F.lit(False)))
    text = F.when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda x: x["line"]), "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def oracle(max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT rn, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT rn, i, list_extract(ws, i) || chr(10) || list_extract(ws, i + 1) || chr(10) || list_extract(ws, i + 2) AS gram FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
y AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS c FROM x) WHERE c > 1),
z AS (SELECT rn, count(DISTINCT i + k) AS n_repeat_words FROM y, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rn),
l AS (SELECT rn, host, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS place FROM d),
dl AS (SELECT rn, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rn),
nl AS (SELECT rn, host, place, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
hl AS (SELECT rn, host, place, line, length(line) AS size FROM nl WHERE line <> ''),
c AS (SELECT rn, string_agg(line, chr(10) ORDER BY place) AS all_lines FROM hl GROUP BY rn),
o AS (SELECT host, line FROM hl JOIN c USING (rn) GROUP BY host, line HAVING count(DISTINCT all_lines) > {max_docs}),
g AS (SELECT hl.rn, sum(size) AS chars, coalesce(sum(size) FILTER (WHERE o.line IS NOT NULL), 0) AS gone FROM hl LEFT JOIN o ON hl.host = o.host AND hl.line = o.line GROUP BY hl.rn),
s AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(gone, 0) AS gone
  FROM d JOIN w USING (rn) LEFT JOIN z USING (rn) LEFT JOIN dl USING (rn) LEFT JOIN g USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone <= chars * {max_removed} AS kept, CAST(gone AS BIGINT) AS removed_chars FROM s"""
