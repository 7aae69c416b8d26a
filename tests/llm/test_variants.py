import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.llm import variants
from bandwright.llm.wavelet import WaveletTree

SCHEMA = "doc_id long, text string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5):
    n = Counter()
    for doc, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    forms, out = {}, []
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        forms[w] = (best if best and n[best] >= 5 * n[w] else None, len(found))
    for w in n:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, n[w], forms[w][1], forms[w][0], n.get(forms[w][0]), root))
    return sorted(out)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 200):
        y = rng.permutation(n)
        tree = WaveletTree(y)
        x0, y0 = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        x1, y1 = np.minimum(n, x0 + rng.integers(0, n + 1, 50)), np.minimum(n, y0 + rng.integers(0, n + 1, 50))
        found = sorted(zip(*(a.tolist() for a in tree.report(x0, x1, y0, y1)), strict=True))
        assert found == sorted((q, int(v)) for q in range(50) for v in y[x0[q] : x1[q]] if y0[q] <= v < y1[q])


def some_rows(n=120):
    rng = random.Random(11)
    bases = ["aabbaab", "letters", "straße", "élève", "colour", "aaaaaaa", "abcdefghijklmnopqrstuvwxyz" * 2, "Ünïcödé"]
    words = []
    for b in bases:
        words += [b] * 30
        for _ in range(12):
            i, c = rng.randrange(len(b)), rng.choice("abé")
            words += [rng.choice([b[:i] + c + b[i:], b[:i] + b[i + 1 :], b[:i] + c + b[i + 1 :]])] * rng.choice([1, 3])
    return [(i, rng.choice([" ", "1", "-", "×"]).join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(n)]


@pytest.mark.parametrize(("most", "tree", "parts"), [(100_000, 50_000, 1), (3, 20, 5), (1, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, most, tree, parts):
    monkeypatch.setattr(variants, "TREE_WORDS", tree)
    rows = [*some_rows(), (7, None), (None, "letters letterz " * 9), (8, ""), (8, "colour " * 7)]
    found = variants.variants(spark.createDataFrame(rows, SCHEMA).repartition(parts), most=most).collect()
    expected = brute(rows)
    assert len(expected) > 60 and any(r[3] for r in expected) and sorted(map(tuple, found), key=lambda r: r[0]) == expected


def test_chain_of_forms(spark):
    rows = [(i, " ".join(w for w, n in (("lettera", 5), ("letterb", 30), ("letterbb", 200), ("letterbbc", 1500)) for _ in range(n))) for i in range(1)]
    found = {r["word"]: (r["form"], r["root"]) for r in variants.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {r[0]: (r[3], r[5]) for r in brute(rows)} and found["lettera"] == ("letterb", "letterbbc")


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "colour " * 9), (1, "colour " * 9), (None, None)], SCHEMA)
    assert variants.variants(docs.limit(0)).collect() == []
    further = docs.withColumns({c: F.lit("x") for c in ("word", "n", "form", "root")})
    assert [tuple(r) for r in variants.variants(further).collect()] == brute([(1, "colour " * 9)] * 2)
    assert variants.variants(spark.createDataFrame([(1, "ab " * 50)], SCHEMA)).collect() == []
