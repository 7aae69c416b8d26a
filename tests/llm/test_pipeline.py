import random
import re
import zlib

import __spark_entry__
import corpus_pipeline
import numpy as np
from bandwright.llm import decontaminate, quality, tokens
from bandwright.llm.passages import plain_hashes
from pyspark.sql import functions as F
from test_dedup import brute, edited, words

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, last = spark.read.parquet(f"{DATA}/documents.parquet"), 10**9
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("hash", F.lit(1)), DATA)
        assert out.columns == [*docs.columns, "hash"]
        out.drop("hash").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= last
        last = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select(F.explode("pieces").alias("p")).select("p.doc_id").distinct().count() == last


def test_entry_has_all():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def judged_by_hand(rows):
    """The quality rules by their definition: doc_id to the cleaned text of what stays."""
    lines = lambda t: [re.sub(r"[ \t\v-\r]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ") for x in t.split("\n")]
    held = {}
    for _, text, source in rows:
        for line in set(lines(text or "")) - {""}:
            held.setdefault((source, line), set()).add(tuple(x for x in lines(text or "") if x))
    out = {}
    for doc_id, text, source in rows:
        w = (text or "").split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        often = [len(held.get((source, x), ())) > quality.MAX_DOCS for x in lines(text or "")]
        gone = sum(len(x) for x, o in zip(lines(text or ""), often, strict=True) if o)
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and gone <= quality.MAX_REMOVED * sum(map(len, lines(text or ""))):
            out[doc_id] = "\n".join(x for x, o in zip(text.split("\n"), often, strict=True) if not o)
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(41)
    text = lambda n: "\n".join(" ".join(words(rng, 12)) for _ in range(n))
    items = [(i, " ".join(words(rng, 25))) for i in range(6)]
    passages = [" ".join(words(rng, 70)) for _ in range(3)]
    rows = []
    for k in range(90):
        body = text(8)
        if k % 6 == 0:
            body = f"{text(4)}\n{passages[k // 6 % 3]}\n{text(4)}"
        elif k % 6 == 1:
            body = f"{text(5)}\n{' '.join(edited(rng, items[k % 5][1].split(), 0.1))}\n{text(3)}"
        elif k % 6 == 2:
            body = "\n".join(" ".join(edited(rng, x.split(), 0.01)) for x in rows[k - 1][1].split("\n")) if k % 12 == 2 else body + "\nRead more about this on page 7"
        elif k % 6 == 3:
            body = rng.choice(["short", "word " * 80, body])
        rows.append((k, body, f"s{k % 2 if k % 6 == 2 else 0}"))
    rows += [(200, None, "s0"), (201, "", None), (202, rows[4][1], "s0"), (203, rows[4][1], "s0")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, left = dict(corpus_pipeline.STAGES), docs
    after = {}
    for name in list(stages)[:-1]:
        stages[name](spark, left, str(tmp_path)).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        after[name] = {r["doc_id"]: r["text"] for r in left.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in left.collect())
    assert after["quality"] == judged_by_hand(rows)
    roots = brute(list(after["quality"].items()), 5)
    assert after["near_duplicates"] == {k: t for k, t in after["quality"].items() if roots[k][1] == k} and len(after["near_duplicates"]) < len(after["quality"])
    seen, expected = set(), {}
    for k, t in sorted(after["near_duplicates"].items()):
        found = [p for p in passages if p in t]
        expected[k] = [p for p in found if p in seen]
        seen.update(found)
    assert sum(map(len, expected.values())) >= 9
    for k, t in after["near_duplicates"].items():
        cut = after["substring"][k]
        assert cut == t if not expected[k] else cut.split() == " ".join(t.replace(p, " ") for p in expected[k]).split()
    near = lambda item, t: decontaminate.smith_waterman(plain_hashes(item.encode()), plain_hashes(t.encode()))[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(item.split())
    assert after["decontaminate"] == {k: t for k, t in after["substring"].items() if not any(near(x, t) for _, x in items)} and len(after["decontaminate"]) < len(after["substring"])
    ids = tokens.WordTokenizer(tokens.default_path())
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        whole = np.frombuffer(r["ids"], "<u4")
        for x in r["pieces"]:
            pieces.setdefault(x["doc_id"], []).append((x["start"], whole[x["offset"] : x["offset"] + x["length"]].tobytes()))
    packed = {k: zlib.crc32(b"".join(b for _, b in sorted(v))) for k, v in pieces.items()}
    assert packed == {k: zlib.crc32(ids.whole(t.encode()) + (1).to_bytes(4, "little")) for k, t in after["decontaminate"].items()}


def test_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
