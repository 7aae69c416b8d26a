import random

import pytest

from bandwright.llm import decontaminate
from test_dedup import SCHEMA, words


@pytest.mark.parametrize("step", [3, 4])
def test_evenly_edited_copies_leak(spark, step):
    rng, items, docs = random.Random(step), [], []
    for n in range(15, 60, 3):
        for phase in range(step):
            item, k = words(rng, n), len(items)
            copy = [f"e{k}x{i}" if i % step == phase else w for i, w in enumerate(item)]
            items.append((k, " ".join(item)))
            docs.append((k, " ".join(words(rng, 40) + copy + words(rng, 40))))
    plain = {(k, k) for k in range(len(items)) if decontaminate.smith_waterman(*(decontaminate.plain_hashes(x.encode()) for x in (items[k][1], docs[k][1])))[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(items[k][1].split())}
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert len(plain) > 40 and plain == {(r["doc_id"], r["item_id"]) for r in found.collect()}


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_copies_with_words_put_in_leak(spark, step):
    """A word after every step-th one: all that Smith-Waterman calls copies are found."""
    rng, items, docs = random.Random(step), [], []
    for k, n in enumerate(range(15, 60, 3) if step > 1 else range(15, 75, 2)):
        item = words(rng, n)
        copy = [x for i, w in enumerate(item) for x in ([w, f"p{k}x{i}"] if (i + 1) % step == 0 else [w])]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(words(rng, 40) + copy + words(rng, 40))))
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert true_leaks(items, docs) == {(k, k) for k in range(len(items))} == {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_mixed_edits_leak(spark):
    """Words replaced, left out and put in by chance, in runs too: what scores at the threshold is found, and nothing else."""
    rng, items, docs = random.Random(9), [], []
    for k in range(160):
        item, rate = words(rng, rng.randrange(10, 60)), rng.choice((0.2, 0.3, 0.4, 0.5))
        copy = []
        for i, w in enumerate(item):
            edit = rng.random() < rate
            kind = rng.randrange(3) if edit else 3
            copy += [[f"e{k}x{i}"], [], [w, *(f"p{k}x{i}y{j}" for j in range(rng.randrange(1, 3)))], [w]][kind]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(words(rng, 30) + copy + words(rng, 30))))
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    plain = true_leaks(items, docs)
    assert 60 < len(plain) < 160 and plain == {(r["doc_id"], r["item_id"]) for r in found.collect() if r["doc_id"] == r["item_id"]}


def true_leaks(items, docs):
    hashes = lambda x: decontaminate.plain_hashes(x.encode())
    scored = ((k, decontaminate.smith_waterman(hashes(items[k][1]), hashes(docs[k][1]))[0] / (decontaminate.MATCH * len(items[k][1].split()))) for k in range(len(items)))
    return {(k, k) for k, score in scored if score >= decontaminate.THRESHOLD}
