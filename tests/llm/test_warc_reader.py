import gzip
import io
import time

from pyspark.sql import functions as F

from bandwright.llm import warc


def test_large_records_are_read_in_linear_time():
    def seconds(megabytes):
        body = bytes(megabytes << 20)
        data = warc.arc_version_block(1, "x.arc", "20200101000000") + warc.arc_record(1, "http://a/b", "20200101000000", "text/html", body)
        began = time.process_time()
        found = list(warc.arc_records(io.BytesIO(data)))
        assert [(len(p), e) for _, p, e in found] == [(len(body), None)]
        return time.process_time() - began

    assert seconds(256) < 5


def test_lines_and_counts_across_reads():
    data = b"".join(b"x" * n + b"\n" for n in (0, 1, 65535, 65536, 70000, 200000)) + b"no end"
    for raw in (data, gzip.compress(data[:1000]) + gzip.compress(data[1000:])):
        reader = warc.Bytes(io.BytesIO(raw))
        assert [len(reader.line()) for _ in range(3)] == [1, 2, 65536] and reader.take(65537) == b"x" * 65536 + b"\n"
        assert [len(reader.line()) for _ in range(4)] == [70001, 200001, 6, 0]


def test_encoded_urls_come_back(spark, tmp_path):
    urls = ["http://a/b%20c", "http://a/100%", "http://a/b c", "http://a/%25"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    back = warc.read_warc(warc.convert(warc.revisits(warc.write_arc(pages, f"file://{tmp_path}/arc")), f"file://{tmp_path}/warc"))
    assert [r["url"] for r in back.orderBy("page_id").collect()] == ["http://a/b%20c", "http://a/100%", "http://a/b%20c", "http://a/%25"]


def test_scanned_archives_have_revisits(spark, tmp_path):
    same, other = b"y" * 200, b"z" * 200
    for name, payloads in (("a", [same, other]), ("b", [same, b"short", b"short"])):
        (tmp_path / f"{name}.arc").write_bytes(warc.arc_version_block(1, name, "20200101000000") + b"".join(warc.arc_record(1, f"http://{name}/{i}", "20200101000000", "text/html", p) for i, p in enumerate(payloads)))
    listed = spark.createDataFrame([(f"file://{tmp_path}/{n}.arc",) for n in "ab"], "file string")
    back = warc.read_warc(warc.convert(warc.revisits(warc.scan_arc(listed)), f"file://{tmp_path}/warc")).orderBy("url").collect()
    assert [(r["url"], r["record_type"]) for r in back] == [("http://a/0", "response"), ("http://a/1", "response"), ("http://b/0", "revisit"), ("http://b/1", "response"), ("http://b/2", "response")]
    assert warc.revisits(warc.scan_arc(listed)).where(F.col("response_file").isNotNull()).count() == 1
