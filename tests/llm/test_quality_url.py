import time

import duckdb
import pytest
from pyspark.sql import functions as F

from bandwright.llm import quality, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i}" for i in range(60))


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_base_counts(spark):
    rows = [(1, "a b c a b c x\n#a\n#a\n \n", None, "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "  lone ", "en", "s", 1), (5, "a a a a", None, None, 2)]
    found = {r["doc_id"]: r for r in quality.verdicts(docs(spark, rows)).collect()}
    assert tuple(found[1][c] for c in quality.STATS) == (9, 11, 2, 1, 6)
    assert tuple(found[2][c] for c in quality.STATS) == (0, 0, 0, 0, 0) and found[2]["base_failed"] and not found[2]["kept"]
    assert found[4]["n_words"] == 1 and found[5]["n_repeat_words"] == 4


def lines(k, n=12):
    return "\n".join(f"line {chr(97 + k)}{chr(97 + i)} of its own number{i} x{k}y{i}z " + " ".join(f"{chr(97 + k)}{chr(97 + i)}{chr(97 + j)}" for j in range(8)) for i in range(n))


def test_frequent_lines_and_copies(spark):
    banner = "Subscribe now and never miss a story 7"
    rows = [(k, f"{lines(k)}\n{banner}", "en", "host", 1) for k in range(14)]
    rows += [(100 + k, lines(20), "en", "host", 1) for k in range(30)]  # copies count once
    rows += [(200, f"{lines(21)}\n{banner}", "en", "other", 1)]
    rows += [(300, "\n".join([banner] * 12), "en", "host", 1)]  # nothing but the line, but it repeats itself
    judged = {r["doc_id"]: r for r in quality.verdicts(docs(spark, rows)).collect()}
    assert all(judged[k]["kept"] and judged[k]["removed_chars"] == len(banner) for k in range(14))
    assert all(judged[100 + k]["kept"] and judged[100 + k]["removed_chars"] == 0 for k in range(30))
    assert judged[200]["removed_chars"] == 0 and not judged[300]["kept"]
    extra = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("hash", F.lit(2))
    out = {r["doc_id"]: r for r in quality.clean(extra).collect()}
    assert out[3]["text"] == lines(3) and out[200]["text"].endswith(banner) and 300 not in out and out[3]["hash"] == 2


def test_documents_are_copies_by_their_whole_text(spark, tmp_path):
    """300 documents of 7 texts with one set of lines count as 7; and as 7 more under another host."""
    one, two = lines(1, 1), lines(2, 1)
    texts = ["\n".join([one] * a + [two] * b) for a, b in ((1, 1), (2, 1), (1, 2), (3, 1), (1, 3), (2, 2))] + [f"{two}\n{one}"]
    rows = docs(spark, [(k, ("  " if k % 2 else "") + texts[k % 7].upper() + "\n" * (k % 3), "en", "h", 1) for k in range(300)])
    rows = rows.unionByName(docs(spark, [(1000 + k, texts[k], "en", "i", 1) for k in range(7)]))
    for limit, gone in ((6, True), (7, False)):
        judged = quality.verdicts(rows, max_docs=limit).collect()
        assert len(judged) == 307 and {bool(r["removed_chars"]) for r in judged} == {gone}
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for limit, gone in ((6, True), (7, False)):
        assert {bool(x) for (x,) in db.execute(f"SELECT removed_chars FROM ({quality.oracle(limit)})").fetchall()} == {gone}


def test_shared_lines_do_not_hide_each_other(spark):
    shared = ["the first line that all of them hold", "and the second of these lines", *(f"template line {chr(97 + i)}" for i in range(20))]
    for n in (2, 22):
        rows = [(k, "\n".join([*shared[:n], lines(k % 20, 2), " ".join(f"own{k}x{chr(97 + i)}" for i in range(60)).replace(str(k), "".join(chr(97 + int(c)) for c in str(k)))]), "en", "h", 1) for k in range(500)]
        judged = quality.verdicts(docs(spark, rows)).collect()
        least = sum(map(len, shared[:n]))
        assert all(r["removed_chars"] >= least for r in judged) and len(judged) == 500
        hashes = {r["hash"] for r in docs(spark, [(0, "\n".join(shared[:n]), "", "", 0)]).select(F.explode(quality.line_hashes(F.col("text"))).alias("hash")).collect()}
        assert all(hashes <= set(r["removed"]) for r in judged)


def test_many_frequent_lines_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(k, "\n".join(f"shared {chr(97 + i)} line" for i in range(20)) + "\n" + lines(k), "en", "h", 1) for k in range(15)]
    one = sorted(map(str, quality.verdicts(docs(spark, rows)).drop("removed").collect()))
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 3)
    assert sorted(map(str, quality.verdicts(docs(spark, rows).repartition(3)).drop("removed").collect())) == one


def test_clashing_names_and_long_text(spark):
    rows = [(1, WORDS, "en", "s", 1), (2, " ".join(f"w{i % 90_000}" for i in range(300_000)), "en", "s", 1), (3, None, "en", "s", 1)]
    odd = docs(spark, rows)
    for name in ("judged_id", "judged_removed", "host", "row", "lines", "copy", "often", "a.b"):
        odd = odd.withColumn(name, F.lit(name))
    out = {r["doc_id"]: r for r in quality.clean(odd).collect()}
    assert set(out) == {1} and out[1].asDict()["judged_id"] == "judged_id" and list(out[1].asDict()) == odd.columns
    counts = {r["doc_id"]: r for r in quality.verdicts(odd).collect()}
    assert counts[2]["n_words"] == counts[2]["n_repeat_words"] == 300_000 and counts[1]["n_repeat_words"] == 0


def test_depleted_document_goes(spark):
    banner = "\n".join(f"boilerplate {chr(97 + i)} with words " + " ".join(f"b{chr(97 + i)}{chr(97 + j)}" for j in range(8)) for i in range(6))
    rows = [(k, f"{lines(k, 30)}\n{banner}", "en", "h", 1) for k in range(14)] + [(50, f"{banner}\nshort own line", "en", "h", 1)]
    judged = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs(spark, rows)).collect()}
    assert not judged[50] and all(judged[k] for k in range(14))


def test_quality_sql_and_empty(spark):
    assert quality.verdicts(docs(spark, [])).count() == 0 and quality.clean(docs(spark, [])).count() == 0
    rows = [(1, "x\ty\vz\n\nA a 12 b\nA a 3 b", None, None, 1), (1, "dup", "en", "s", 1), (1, "dup", "en", "s", 1), (None, "n", "en", "s", 1), (2, WORDS, "en", "s", 1), (3, "long " * 30_000, "en", "s", 1)]
    con = duckdb.connect()
    con.register("documents", docs(spark, rows).toPandas().astype({"doc_id": "Int64"}))
    theirs = con.execute(quality.oracle()).fetchall()
    columns = [d[0] for d in con.description]
    ours = [tuple(r[c] for c in columns) for r in quality.verdicts(docs(spark, rows)).collect()]
    assert sorted(map(str, ours)) == sorted(map(str, theirs))


def page(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://A.example.COM/en/1", "example.com/en/", "block"), ("https://www.example.com/en/x?q", "www.example.com/en/", "allow"), ("https://x.www.example.com/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "com/", "allow"), ("http://example.com", None, "allow"), ("http://a.net/es/", "net/es/", "block"), ("http://a.net/ES/", None, "allow"),
        ("http://spam-farm.example.org/en/1", None, "block"), ("no scheme", None, "allow"), (None, None, "allow"), ("http://spam-farm.net/fr/?x", "net/fr/", "block"), ("://com/", "com/", "allow"), ("", None, "allow"),
    ],
)
def test_url(spark, url, rule, verdict):
    r = urlfilter.judge(page(spark, [url])).first()
    assert (r["rule"], r["verdict"]) == (rule, verdict)


def test_url_rows_stay(spark):
    df = page(spark, ["http://a.com/", "http://a.com/", None]).withColumn("token", F.lit(1)).union(page(spark, ["http://a.com/"]).withColumn("token", F.lit(1)))
    assert urlfilter.judge(df).count() == 4 and urlfilter.judge(df, ()).count() == 4 and urlfilter.judge(df.where("false")).count() == 0


def test_line_ends_and_odd_letters(spark):
    urls = ["http://x.org/a\nb/casino/c\n", "http://x.org/wp-login.php\n", "http://x.xxx/\nq", "http://É.org/é(b", "http://x.org/e(b"]
    rules = (*urlfilter.DEFAULT_RULES, urlfilter.glob_rule("*/é(b"), urlfilter.glob_rule("*.php"))
    found = [r["pattern"] for r in urlfilter.judge(page(spark, urls), rules).orderBy("page_id").collect()]
    assert found == ["*/casino/*", "*/wp-login.php*", "*.xxx/*", "*/é(b", None]


def test_fifty_thousand_rules(spark, monkeypatch):
    rules = [urlfilter.prefix_rule(f"host{k}.org", f"/p{k % 7}/", "block") for k in range(49_990)] + [urlfilter.glob_rule(f"*/g{k}/*") for k in range(10)]
    urls = [f"http://www.host{k}.org/p{k % 5}/x" for k in range(0, 2000, 7)] + [f"http://z.com/{k}/g{k}/" for k in range(20)]
    began = time.time()
    found = [r["rule"] or r["pattern"] for r in urlfilter.judge(page(spark, urls), tuple(rules)).orderBy("page_id").collect()]
    assert time.time() - began < 40
    assert found == [f"host{k}.org/p{k % 7}/" if k % 7 == k % 5 else None for k in range(0, 2000, 7)] + [f"*/g{k}/*" if k < 10 else None for k in range(20)]
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 10)
    table = urlfilter.rule_table(spark, tuple(rules[-200:]))
    assert [r["pattern"] for r in urlfilter.judge(page(spark, urls), table).orderBy("page_id").collect()] == [None if f is None or f[0] == "h" else f for f in found]


def test_rules_without_token(spark):
    rules = (urlfilter.glob_rule("*pill*"), urlfilter.prefix_rule("com", "/", "allow"))
    assert rules[0].tokens == () and rules[1].tokens == ("com",)
    found = [r["verdict"] for r in urlfilter.judge(page(spark, ["http://mypills.org/", "http://a.org/"]), rules).orderBy("page_id").collect()]
    assert found == ["block", "allow"]
