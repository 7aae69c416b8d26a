import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import collocation

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, least, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if a < least or len(p) == 1:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in counts.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def some_rows(n=60):
    rng = random.Random(3)
    parts = ["The", "old mill", "river", "New York", "new york City", "ÉTÉ", "the,", "mill.", "a\tb", "x\x0by", "!", "in spite of", "a a a a"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " \n"), ("fr", ".,;"), ("en", "of " * 500), ("xx", "straße 日本 straße 日本 " * 9)]


@pytest.mark.parametrize(("least", "parts", "block", "bits"), [(30, 1, 2_000_000, 1 << 26), (5, 7, 50, 1 << 10), (2, 3, 400, 64)])
def test_equals_brute_force(spark, least, parts, block, bits):
    rows = some_rows()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(parts)
    found = collocation.collocations(docs, least=least, words_a_block=block, bits=bits)
    expected = brute(rows, least)
    assert expected and sorted(map(tuple, found.collect())) == expected
    assert sorted(map(tuple, collocation.collocations(docs, least=least, rows=3).collect())) == brute(rows, least, 3)


def test_arithmetic_passes_64_bits(spark):
    big = 2**60
    known = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)], "lang string, k int, phrase string, a long")
    row = collocation.scored(known).first()
    assert row["score"] == 2000000 * (big - 1) // (2 * big + 1)


def test_texts_of_phrases_come_once(spark, monkeypatch):
    """Blocks gave the text of each frequent phrase, so rows grew with blocks times phrases; now they give numbers alone, and texts are joined from words."""
    made, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, *a, **b: made.append(schema) or plain(self, f, schema, *a, **b))
    docs = spark.createDataFrame([(i, "en", "a b c d e a b") for i in range(40)], SCHEMA).repartition(4)
    found = collocation.phrases(collocation.blocks(docs, words_a_block=20), longest=5)
    assert not [x for x in made if "phrase" in x]
    rows = sorted((r["k"], r["phrase"], r["a"]) for r in found.collect())
    expected = Counter()
    for k in range(1, 6):
        expected.update(" ".join("a b c d e a b".split()[i : i + k]) for i in range(8 - k))
    assert rows == sorted((p.count(" ") + 1, p, 40 * n) for p, n in expected.items())


def test_words_of_like_hashes_have_their_own_numbers(spark):
    """No two words have one number, whatever their hashes."""
    top = collocation.OTHERS << 32
    keys = [5 << 32, 5 << 32, 5 << 32 | 1, 7 << 32, top | 3]
    words = [("en", b"a"), ("de", b"a"), ("en", b"b"), ("en", b"c"), ("en", b"d")]
    table = np.full(1, ~np.uint64(0))
    rows = spark.createDataFrame([(lang, w, 30, int(np.uint64(k).view(np.int64))) for (lang, w), k in zip(words, keys, strict=True)], "lang string, word binary, n long, key long")
    numbers = collocation.numbers_for(rows, spark.sparkContext.broadcast(table))
    found = numbers.of([x for x, _ in words], [w for _, w in words], np.array(keys, np.uint64)).tolist()
    assert len(set(found)) == 5 and found[3] == 7 and all(collocation.OTHERS < x < 1 << 32 for x in found[:3] + found[4:])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "en", "a b " * 40), (1, "en", "a b"), (1, "en", "a b")], SCHEMA)
    assert collocation.collocations(docs.limit(0)).collect() == []
    further = docs.withColumns({c: F.lit("x") for c in ("phrase", "words", "n", "rank")})
    assert sorted(map(tuple, collocation.collocations(further).collect())) == brute([("en", "a b " * 40), ("en", "a b"), ("en", "a b")], 30)
