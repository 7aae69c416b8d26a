import random
from collections import defaultdict

from pyspark.sql import functions as F

from bandwright.llm import decontaminate, neardup, substring
from bandwright.llm.common import AT_ONCE, word_hashes
from bandwright.llm.passages import plain_hashes, without

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(2000)}" for _ in range(n)]


def edited(rng, text, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text]


def brute(rows, n, percent=80):
    sets, parent = {}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, t in rows:
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_rows(seed=3):
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = words(rng, rng.choice([2, 5, 20, 80, 150]))
        for _ in range(rng.choice([1, 3, 12])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08]))))
    rows += ["", "one", "one", "ONE ", "a b", "a b c d e", "a b c d", None, "x " * 500]
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    for n in (2, 5):
        rows = near_rows()
        found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("sketch", F.lit(0)), n).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, n)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_chain_of_links(spark):
    rng = random.Random(1)
    base, rows = words(rng, 120), []
    for k in range(25):
        rows.append((k, " ".join(base)))
        for i in rng.sample(range(120), 4):
            base[i] = f"n{k}x{i}"
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()} == {k: v[1] for k, v in brute(rows, 2).items()}


def test_exact_join_finds_what_a_star_hides(spark):
    rng = random.Random(2)
    base = words(rng, 100)
    near = [" ".join(edited(rng, base, 0.06)) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(near)), SCHEMA)
    roots = spark.createDataFrame([(0, 0)], "node long, root long")
    pairs = {(r["a"], r["b"]) for r in neardup.prefix_pairs(rows, roots, 2, 80).collect()}
    expected = {(a, b) for a in range(30) for b in range(a + 1, 30) if brute([(a, near[a]), (b, near[b])], 2)[b][1] == a}
    assert expected and expected <= pairs


def test_near_duplicates_odd_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "same text here"), (5, "same text here"), (5, "same text here"), (7, "same text here"), (8, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert len(out) == 5 and {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(None, None, True), (5, 5, True), (7, 5, False), (8, 8, True)}
    left = neardup.one_of_each(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)), 2).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["5", "5", "8", "None"]


def test_bands_and_estimate_lose_no_pair_at_the_threshold():
    import numpy as np

    rng, errors, lost = np.random.default_rng(1), [], 0
    for k in range(400):
        n = (30, 200, 2000)[k % 3]
        both = -(-n * 8 // 9)  # Jaccard 0.8 or a little more
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = np.concatenate([a[:both], rng.integers(0, 2**63, n - both, dtype=np.uint64) * np.uint64(2)])
        x, y = (np.frombuffer(neardup.hyperminhash(np.unique(v)), "<u2") for v in (a, b))
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = neardup.estimated(x, y)
        errors.append(found - real)
        lost += found < neardup.least_estimate(80, min(n, neardup.REGISTERS))
        bands = [(x[i : i + neardup.ROWS] == y[i : i + neardup.ROWS]).all() for i in range(0, neardup.BANDS * neardup.ROWS, neardup.ROWS)]
        lost += not any(bands)
    assert lost == 0 and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_parts_of_hot_tokens(spark, monkeypatch):
    rng = random.Random(12)
    base = words(rng, 60)
    rows = [(k, " ".join(edited(rng, base, 0.05))) for k in range(60)]
    df, roots = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, 0)], "node long, root long")
    one = {(r["a"], r["b"]) for r in neardup.prefix_pairs(df, roots, 2, 80).collect()}
    monkeypatch.setattr(neardup, "MEET", 5)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    assert {(r["a"], r["b"]) for r in neardup.prefix_pairs(df, roots, 2, 80).collect()} == one
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2).collect()} == brute(rows, 2)


def passage_rows():
    rng, rows = random.Random(7), []
    shared = [words(rng, n) for n in (51, 60, 200, 900)]
    for k in range(40):
        text = words(rng, rng.randrange(60, 200))
        if k % 2:
            p = shared[k % 4 if k % 3 else 3]
            at = rng.randrange(len(text))
            text[at:at] = edited(rng, p, 0.05 if k % 5 == 0 else 0)
        rows.append((k, " ".join(text)))
    return rows


def test_repeats_find_every_exact_run(spark):
    rows = passage_rows() + [(90, None), (91, ""), (92, "short"), (None, " ".join(["w"] * 100))]
    found = substring.repeats(spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("x"))).collect()
    spans, seen = defaultdict(list), {}
    for r in found:
        assert r["ref_id"] < r["doc_id"] and r["identity"] >= substring.IDENTITY
        spans[r["doc_id"]].append((r["start"], r["stop"]))
    for k, t in rows[:40]:
        h = plain_hashes(t.encode())
        own = [h[i : i + 50].tobytes() for i in range(len(h) - 49)]
        for i, w in enumerate(own):
            if w in seen:
                assert all(any(a <= j < b for a, b in spans[k]) for j in range(i, i + 50)), (k, i)
        for w in own:
            seen.setdefault(w, k)
    assert {k for k in spans} <= {k for k, _ in rows[:40] if k % 2}


def test_repeats_do_not_depend_on_the_layout(spark, monkeypatch):
    rng = random.Random(21)
    rows = passage_rows() + [(200 + k, " ".join(words(rng, 30) + passage_rows()[1][1].split()[:90] + words(rng, 20))) for k in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, substring.repeats(df.repartition(1)).collect()))
    assert len(one) > 30
    monkeypatch.setattr(substring, "TOGETHER", 3)
    monkeypatch.setattr(substring, "FLUSH", 500)
    monkeypatch.setattr(substring, "SHARE", 400)
    for parts in (16, 61):
        assert sorted(map(tuple, substring.repeats(df.repartition(parts)).collect())) == one


def test_remove_repeats(spark):
    rows = passage_rows() + [(None, "kept as it is"), (95, None)]
    left = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(3)))
    assert left.columns == ["doc_id", "text", "block"] and left.count() == len(rows)
    assert substring.repeats(left.drop("block")).count() == 0
    copies = spark.createDataFrame([(1, rows[1][1]), (2, rows[1][1]), (2, rows[1][1])], SCHEMA)
    assert [r["doc_id"] for r in substring.remove_repeats(copies).collect()] == [1]
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_chain_equals_quadratic():
    rng = random.Random(4)
    for _ in range(60):
        m = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
        score = []
        for i, (p, r) in enumerate(m):
            score.append(substring.K + max([0.0, *(score[j] - substring.GAP_COST * (p - x + r - y) for j, (x, y) in enumerate(m[:i]) if x < p and y < r)]))
        chain = [m[i] for i in next(substring.all_chains(m))]
        value = sum(substring.K for _ in chain) - sum(substring.GAP_COST * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(chain, chain[1:], strict=False))
        assert abs(value - max(score)) < 1e-9


def test_without():
    assert without("A, b -- c. D e", [(1, 3)]) == "A,  D e"


def test_word_hashes():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé.,") for _ in range(rng.randrange(1, 9))) for _ in range(3000)) + "\t\n x\x0b" + "long" * 3000
    for t in (text, "", " ", ".. ,", "one", text * (1 + 3 * AT_ONCE // len(text))):
        words_, plain = t.encode().split(), [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in t.lower().split()) if w]
        for h, expected in ((word_hashes(t.encode()), words_), (plain_hashes(t.encode()), plain)):
            known = dict(zip(expected, h.tolist(), strict=True))
            assert [known[w] for w in expected] == h.tolist() and len(set(known.values())) == len(known) and 0 not in known.values()
    assert plain_hashes(b"A, b").tolist() == plain_hashes(b"'a B!").tolist() and plain_hashes("É".encode())[0] == plain_hashes("é".encode())[0]


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((15, 30, 60))] + [(8, "two words"), (9, None), (9, ""), (None, "x y z")]
    docs = []
    for k in range(30):
        text = words(rng, 120)
        if k < 9:
            text[40:40] = edited(rng, items[k % 3][1].split(), (0, 0.1, 0.2)[k // 3])
        docs.append((k, " ".join(text)))
    docs += [(50, "these two words, alone"), (51, None), (None, items[0][1].upper() + "!")]
    table = spark.createDataFrame(docs, SCHEMA)
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, tests).collect()}
    assert found == {(k, k % 3) for k in range(9)} | {(50, 8), (None, 0)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(table, tests).collect()} == set(range(9, 30)) | {51}
    assert decontaminate.leaks(table, tests.where("false")).count() == 0 and decontaminate.leaks(table.where("false"), tests).count() == 0


def test_rare_seeds_keep_what_all_pairs_find(spark):
    rng = random.Random(31)
    common = words(rng, 25)  # frequent bigrams of many items
    items = [(i, " ".join(words(rng, 6) + common[i % 5 : i % 5 + rng.randrange(3, 20)] + words(rng, rng.randrange(4, 20)))) for i in range(25)]
    docs = []
    for k in range(100):
        text, own = words(rng, 60), items[k % 25][1].split()
        if k < 75:
            step = (3, 4, 10)[k // 25]
            text[20:20] = [w if j % step != k % step else f"e{k}x{j}" for j, w in enumerate(own)] if k % 2 else [w for j, w in enumerate(own) if j % step != k % step]
        else:
            text[10:10] = common
        docs.append((k, " ".join(text)))
    plain = {(k, i) for k, t in docs for i, x in items if decontaminate.smith_waterman(plain_hashes(x.encode()), plain_hashes(t.encode()))[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(x.split())}
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(plain) > 70 and {(r["doc_id"], r["item_id"]) for r in found} == plain


def test_blocks_of_items_and_clashing_names(spark, monkeypatch):
    rng = random.Random(32)
    items = [(i, " ".join(words(rng, 20))) for i in range(30)] + [(99, " ".join(words(rng, 6_000)))]
    docs = [(k, " ".join(words(rng, 10)) + " " + items[k][1]) for k in range(0, 30, 3)] + [(99, items[30][1])]
    table, tests = spark.createDataFrame(docs, SCHEMA).withColumn("leaking_id", F.lit(1)).withColumn("cut_id", F.lit(1)).withColumn("cut_spans", F.lit("x")), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaks(table, tests).collect()))
    assert [r[:2] for r in one] == [(k, k) for k, _ in docs]
    assert decontaminate.decontaminate(table, tests).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60_000)
    assert sorted(map(tuple, decontaminate.leaks(table, tests).collect())) == one
    left = substring.remove_repeats(table)
    assert left.columns == table.columns and left.count() == len(docs)


def test_smith_waterman_equals_plain():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, start, stop = decontaminate.smith_waterman(a, b)
        assert score == h.max() and 0 <= start <= stop <= len(b)
        if score:  # the passage itself aligns as well
            assert decontaminate.smith_waterman(a, b[start:stop])[0] == score
