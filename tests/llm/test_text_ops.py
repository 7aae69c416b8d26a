import io
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.llm import langid, packing, tokenfile, tokens, warc

SCHEMA = "doc_id long, text string"
public = pytest.importorskip("public_tokenizers")
PATH = tokens.default_path()
ODD = ["I'm don't WE'LL <|endoftext|>x a<|STARTOFTEXT|>", "é ́x café ΣΑΣ İstanbul straße ẞ", "1234 a1b2 日本語 👍🏽 ok", "x\x1cy a\x85b c d", "stop!! ,, .x x.. «a» 's don's 'x", "", " \n", None, "w" * 5000, "Ünï.#% É,É , É"]


def reference(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def some_texts(n=60):
    rng = random.Random(5)
    return ODD + [" ".join(rng.choice(["The", "riverbank,", "zyx" + str(rng.randrange(50)), "été", "Straße."]) for _ in range(rng.randrange(1, 900))) for _ in range(n)]


def test_tokenizer_equals_library():
    t, texts = tokens.WordTokenizer(PATH), some_texts()
    t.LIMIT = 40  # generations turn over
    found = list(t.encode_all([(x or "").encode() for x in texts]))
    assert t.direct and [np.frombuffer(f, "<u4").tolist() + [2] for f in found] == reference(texts, 2)


def test_words_at_hand_are_bounded_and_small():
    """pipeline, packing: a worker's words took some 120 MB, two generations of 400,000 in dicts; now below 65 MB."""
    t = tokens.WordTokenizer(PATH, tokens.FEW)
    t.fresh = lambda words: [b"12345678" + w[-12:] for w in words]  # the memory of words, not the library
    tracemalloc.start()
    most = 0
    for i in range(0, 900_000, 4_000):
        text = b" ".join(b"word%08d" % k for k in range(i, i + 4_000))
        assert next(t.encode_all([text])) == b"".join(b"12345678" + w[-12:] for w in text.split())
        most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most < 65e6


def test_shelved_words_keep_their_ids():
    known = {b"w%d" % i: i.to_bytes(4 * (1 + i % 3), "little") for i in range(1000)}
    shelf = tokens.Shelf(known)
    assert dict(shelf.find([b"x", *known, b"", b"w1000"])) == known and dict(shelf.find([])) == {} and dict(shelf.find([b"x"])) == {}


def test_vocabularies_that_join_words_take_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    t = Tokenizer(models.BPE({**letters, "\u0120a": 256}, [("\u0120", "a")]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)  # a blank goes with the word behind it
    t.save(str(tmp_path / "t.json"))
    found = tokens.WordTokenizer(str(tmp_path / "t.json"))
    texts = ["a a  b", "", "a\n\na É x"]
    assert not found.by_word and [np.frombuffer(x, "<u4").tolist() for x in found.encode_all(x.encode() for x in texts)] == [t.encode(x).ids for x in texts]
    assert tokens.WordTokenizer(PATH).by_word


def test_vocabularies_that_tell_case_keep_it(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, []))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    t.save(str(tmp_path / "t.json"))
    found = tokens.WordTokenizer(str(tmp_path / "t.json"))
    texts = ["Ab aB ab AB", "", "THE the The."]
    assert found.by_word and not found.folds and not found.direct
    assert [np.frombuffer(x, "<u4").tolist() for x in found.encode_all(x.encode() for x in texts)] == [t.encode(x).ids for x in texts]
    assert tokens.WordTokenizer(PATH).folds


def test_token_files(spark):
    texts = some_texts()
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    out = tokenfile.token_file_digest(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("tie", F.lit(1)), PATH).collect()
    ids = reference(texts, 2)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    known = [r["doc_id"] for r in ordered]
    assert known == [None] * known.count(None) + sorted(k for k in known if k is not None)
    assert tokenfile.token_file_digest(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 32])
def test_bit_packing_and_random_access(bits):
    class Out(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    class In(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    rng, out = np.random.default_rng(bits), Out()
    parts = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 70, 1000, 3)]
    w = tokenfile.Writer(out, bits, block=64)
    for i, p in enumerate(parts):
        w.add(i or None, p)
    w.close()
    r, whole = tokenfile.Reader(In(out.data)), np.concatenate(parts)
    for a, b in ((0, len(whole)), (63, 65), (64, 64), (500, 777), (len(whole) - 1, len(whole))):
        assert r.ids(a, b).tolist() == whole[a:b].tolist()
    assert [(d, s, x.tolist()) for d, s, x in r.documents(10)] == [(i or None, int(sum(map(len, parts[:i]))), p.tolist()) for i, p in enumerate(parts)]
    with pytest.raises(ValueError):
        tokenfile.Reader(In(b"x" * 200))


def test_best_fill_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(4)}
        room, best = rng.randrange(1, 120), 0
        items = list(counts.items())

        def all_sums(k, total):
            if k == len(items):
                yield total
                return
            for n in range(items[k][1] + 1):
                yield from all_sums(k + 1, total + n * items[k][0])

        best = max(s for s in all_sums(0, 0) if s <= room)
        chosen = packing.best_fill(counts, room)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


def test_packing(spark):
    texts = some_texts(120)
    packed = packing.sequences(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2), PATH, capacity=256)
    out = packing.pieces_digest(packed).collect()
    ids = dict(enumerate(np.array(x, "<u4") for x in reference(texts, 1)))
    places, filled = {}, {}
    for r in out:
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own) and r["length"] > 0
        places.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in places.items():
        parts.sort()
        assert [s for s, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) == len(ids[k])
    for parts in filled.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [s for s, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and size <= 256 and size & (size - 1) == 0
    assert set(places) == set(ids) and sum(1 for p in filled.values() if sum(n for _, n in p) == 256) >= len(filled) - 2 * 9
    assert packing.sequences(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.sequences(spark.createDataFrame([], SCHEMA), PATH, capacity=100)


def test_language(spark):
    rng = random.Random(3)
    sound = {"aa": ["ban", "tor", "mel"], "bb": ["xiq", "zup", "kro"], "cc": ["öst", "ühn", "äck"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(4, 60)), lang, lang) for i, lang in enumerate(rng.choice(list(sound)) for _ in range(400))]
    df = spark.createDataFrame([*rows, (900, None, "aa", None), (901, "123 !!", "bb", None), (902, "", None, None), (903, text("cc", 9), None, None), (None, "ban", "aa", "aa"), (904, "q" * 20_000, None, None)], "doc_id long, text string, lang string, score string")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(out) == 406 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(out[k]["held_out"] == (k in set(held)) for k in range(400)) and sum(out[k]["lang_pred"] == rows[k][2] for k in held) >= 0.98 * len(held)
    assert [out[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] == "cc" and not out[904]["accepted"]
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def plain_model(words):
    """Interpolated Kneser-Ney by its definition: p(gram), the probability of a gram's last character after the others."""
    from collections import Counter
    from functools import cache

    raw = Counter(w[end - n : end] for w in map(langid.framed, words) for end in range(2, len(w) + 1) for n in range(1, min(langid.ORDER, end) + 1))
    before = Counter(g[1:] for g in raw)
    count = {g: raw[g] if len(g) == langid.ORDER or g[0] == " " and len(g) > 1 else max(1, before[g]) for g in raw}
    own = {n: [g for g in count if len(g) == n] for n in range(1, langid.ORDER + 1)}
    discount = {}
    for n, grams in own.items():
        once, twice = (sum(count[g] == k for g in grams) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
    total, kinds = Counter(), Counter()
    for g in count:
        total[g[:-1]] += count[g] if len(g) > 1 else 0
        kinds[g[:-1]] += len(g) > 1

    @cache
    def p(gram, alphabet):
        n = len(gram)
        if n == 1:
            everything = sum(count[g] for g in own[1])
            return max(0, count.get(gram, 0) - discount[1]) / everything + discount[1] * len(own[1]) / everything / alphabet
        if not total[gram[:-1]]:
            return p(gram[1:], alphabet)
        return max(0, count.get(gram, 0) - discount[n]) / total[gram[:-1]] + discount[n] * kinds[gram[:-1]] / total[gram[:-1]] * p(gram[1:], alphabet)

    return p


def test_model_equals_definition():
    import pandas as pd

    rng = random.Random(8)
    made = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)] for lang, letters in (("x", "abcé"), ("y", "bcdz"))}
    rows = [(lang, w[end - n : end], 1) for lang, words in made.items() for w in map(langid.framed, words) for end in range(2, len(w) + 1) for n in range(1, min(langid.ORDER, end) + 1)]
    model = langid.Model(["x", "y"], pd.DataFrame(rows, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum())
    alphabet = len(set("abcédz ")) + 1
    plain = {lang: plain_model(words) for lang, words in made.items()}
    for word in [*made["x"][:20], *made["y"][:20], "zab", "qqq", "abcdabcd", "é"]:
        w = langid.framed(word)
        for j, lang in enumerate(("x", "y")):
            expected = sum(np.log(plain[lang](w[max(0, i + 1 - langid.ORDER) : i + 1], alphabet)) for i in range(1, len(w)))
            assert abs(model.score([word])[0][j] - expected) < 1e-3, (word, lang)
    for context in ("", " ", "a", "bc", " ab", "cbab"):
        for lang in plain:
            assert abs(sum(plain[lang](context + c, alphabet) for c in "abcédz q") - 1) < 1e-9


def test_only_letters_count(spark):
    rows = [(k, "some english words here " * 3 if k % 2 else "quelques mots de français " * 3, "en" if k % 2 else "fr") for k in range(40)]
    odd = ["² ³ ¹ " * 5, "½ ¼ ¾ " * 5, "Ⅷ ⅳ Ⅻ " * 5, "①②③ " * 12, "__ 123 ٣", "² é"]
    df = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert [found[100 + i] for i in range(5)] == ["und"] * 5 and found[105] != "und"


def test_warc_round_trip(spark):
    big = "x" * 120
    rows = [(3, "http://a/ b", big), (1, "http://a", big), (2, None, "short"), (4, "u", "short"), (5, "v", None), (6, "w", ""), (7, "é", "é\r\n\r\nWARC/1.1\r\n" * 9), (None, "n", big), (1, "http://a", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    for version in (1, 2):
        out = warc.round_trip(df, version).collect()
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out) == sorted(
            [("3", 120, "revisit", 1), ("1", 120, "response", None), ("1", 120, "response", None), ("None", 120, "response", None), ("2", 5, "response", None), ("4", 5, "response", None), ("5", 0, "response", None), ("6", 0, "response", None), ("7", len("é\r\n\r\nWARC/1.1\r\n".encode()) * 9, "response", None)]
        )
        assert all(len(r["payload_digest"]) == 64 and r["date"] == "2020-01-01T00:00:00Z" for r in out)
    assert warc.round_trip(df.where("false")).count() == 0


def test_arc_versions():
    for version in (1, 2):
        data = warc.arc_version_block(version, "n", "20200101000000") + warc.arc_record(version, "http://a b", "2020", "text/html", b"one\n\n") + b"\n" + warc.arc_record(version, "u", "20200102030405", "t", b"")
        found = list(warc.arc_records(io.BytesIO(data)))
        assert [(f["url"], p, e) for f, p, e in found] == [("http://a%20b", b"one\n\n", None), ("u", b"", None)] and warc.warc_date(found[0][0]["date"]) == "2020-01-01T00:00:00Z"
        assert [x[2] for x in warc.arc_records(io.BytesIO(b"http://x 0.0.0.0 2020 t 3\nabc\n"))] == ["no version block"]


def test_damaged_archives_go_on(spark, tmp_path):
    head, good = warc.arc_version_block(1, "n", "20200101000000"), lambda k: warc.arc_record(1, f"http://h/{k}", "20200101000000", "text/html", b"x" * k)
    files = {
        "blank": (head + b"http://h/a b c 1.2.3.4 2020 text/html 3\nabc\n" + good(5), [None, None]),
        "latin": (head + b"http://h/\xe9 1.2.3.4 2020 text/html 3\nabc\n" + good(5), [None, None]),
        "line": (head + good(4) + b"http://h/ 1.2.3.4 2020\n\xff\xfe junk\n" + good(5), [None, "no record line", None]),
        "short": (head + b"http://h/s 1.2.3.4 2020 text/html 3\nabcdef\nmore\n" + good(5), [None, "no record line", None]),
        "end": (head + good(4) + b"http://h/e 1.2.3.4 2020 text/html 99\nabc\n", [None, "the file ends 95 bytes early"]),
        "none": (b"junk\n" + good(5), ["no version block"]), "empty": (b"", []),
    }
    for name, (data, _) in files.items():
        (tmp_path / f"{name}.arc").write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{name}.arc",) for name in files], "file string")
    scanned = warc.scan_arc(paths)
    found = {}
    for r in scanned.orderBy("file", "place").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1][:-4], []).append(r["error"])
    assert found == {name: errors for name, (_, errors) in files.items() if errors}
    out = warc.convert(warc.revisits(scanned), f"file://{tmp_path}/warc")
    assert out.groupBy().sum("records", "errors").first()[:] == (9, 4)
    back = warc.read_warc(out).collect()
    assert sorted(r["url"] for r in back) == sorted(["http://h/a%20b%20c", "http://h/é", "http://h/s", *["http://h/4"] * 2, *["http://h/5"] * 4]) and len({r["record_id"] for r in back}) == 9


def test_revisits_refer_to_their_response(spark):
    df = spark.createDataFrame([(k, "http://a", "same payload " * 20) for k in range(5)], "page_id long, url string, html string").repartition(3)
    from bandwright.llm.common import run_dir

    folder = run_dir(spark, "test")
    files = warc.convert(warc.revisits(warc.write_arc(df, f"{folder}/arc")), f"{folder}/warc").collect()
    fields, kinds = {}, []
    for f in files:
        where, inside = warc.fs.FileSystem.from_uri(f["file"])
        with where.open_input_stream(inside, compression=None) as source:
            for x, _ in warc.warc_records(source):
                kinds.append(x["WARC-Type"])
                fields[x.get("X-Record")] = x
    assert sorted(kinds) == sorted(["warcinfo"] * len(files) + ["response"] + ["revisit"] * 4)
    assert {fields[str(k)]["WARC-Refers-To"] for k in range(1, 5)} == {fields["0"]["WARC-Record-ID"]}
