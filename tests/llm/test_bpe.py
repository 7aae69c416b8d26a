import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.llm import bpe, tokens

public = pytest.importorskip("public_tokenizers")
PATH = tokens.default_path()
ODD = ["I'm don't WE'LL <|endoftext|>x a<|STARTOFTEXT|>", "é ́x café ΣΑΣ İstanbul straße ẞ", "1234 a1b2 日本語 👍🏽 ok", "x\x1cy a\x85b c d", "stop!! ,, .x x.. «a» 's don's 'x", "", " \n", None, "w" * 5000, "Ünï.#% É,É , É"]


def expected(texts, path=PATH):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids]


def some_texts(n=80):
    rng = random.Random(5)
    return ODD + [" ".join(rng.choice(["The", "riverbank,", "zyx" + str(rng.randrange(50)), "été", "Straße."]) for _ in range(rng.randrange(1, 900))) for _ in range(n)]


def test_variable_length_numbers():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1] * 3)
    data, ends = bpe.to_bytes(numbers)
    assert bpe.from_bytes(data).tolist() == numbers.tolist() and ends[-1] == len(data)
    assert bpe.from_bytes(np.empty(0, np.uint8)).tolist() == [] and bpe.to_bytes(np.empty(0, np.int64))[0].tolist() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_library(spark, parts):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    found = {r[0]: tuple(r)[1:] for r in bpe.round_trip_digest(docs, PATH).collect()}
    assert [found[i] for i in range(len(texts))] == expected(texts)


def test_blocks_do_not_matter(spark):
    texts = some_texts(20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    small = bpe.encode(docs, PATH, words_a_block=100)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, bpe.encode(docs, PATH).collect()))


def test_vocabulary_with_decoder(spark, tmp_path):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    letters = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    t = Tokenizer(models.BPE({**letters, "Ġa": 256}, [("Ġ", "a")]))
    t.pre_tokenizer, t.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    t.save(str(tmp_path / "t.json"))
    texts = ["a a  b", "", "a\n\na É x", "a a  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, str(tmp_path / "t.json")), str(tmp_path / "t.json")).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == dict(enumerate(texts))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (1, "a b"), (2, "")], "doc_id long, text string")
    found = bpe.decode(bpe.encode(docs, PATH), PATH)
    one = expected(["a b"])[0]
    assert sorted((r["doc_id"] or 0, len(r["ids"]) // 4, r["decoded"]) for r in found.collect()) == [(0, one[0], "a</w> b</w>"), (1, 0, ""), (1, 2, "a</w> b</w>"), (1, 2, "a</w> b</w>"), (2, 0, "")]
    assert bpe.round_trip_digest(docs.limit(0), PATH).collect() == []
    further = docs.withColumns({c: F.lit("x") for c in ("ids", "codes", "words", "block", "kept", "decoded")})
    assert bpe.round_trip_digest(further, PATH).count() == 5
    both = bpe.encode(further, PATH, keep=("doc_id", "codes", "words", "block", "kept"))
    assert both.columns == ["doc_id", "codes", "words", "block", "kept", "ids"] and both.where("codes = 'x' and block = 'x'").count() == 5
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).first()["decoded"] == ""
