"""WARC archives, and the converter from the legacy ARC format.

An ARC file starts with a version block; each record is one header line, whose fields the version names, and as many bytes
as the line's last field declares. The converter walks the declared lengths, and gives each record what WARC asks for and
ARC lacks: an identifier (a UUID from the record's own bytes, so a repeated conversion gives the same), an ISO date, a
record type and digests. Records whose payload another record already holds become revisits of it. A damaged line or a
payload that is cut off is an error row; reading goes on at the next line that is a record's.

Files are gzip members, one for each record, in folders that driver and executors share.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import batch, cut, run_dir, texts_of

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
#: About so many payload bytes go to a file.
FILE_BYTES = 64 << 20
#: Tasks that a list of files is dealt to at most.
MOST_TASKS = 20_000
# The fields of a URL record line in versions 1 and 2 of the ARC format.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
IP, DATE, NUMBER = rb"([0-9A-Fa-f.:]+)", rb"(\d{4,14})", rb"(\d+)"
LINES = {
    1: re.compile(rb" ".join((rb"(\S.*)", IP, DATE, rb"(\S+)", NUMBER))),
    2: re.compile(rb" ".join((rb"(\S.*)", IP, DATE, rb"(\S+)", rb"(\S+)", rb"(\S+)", rb"(\S+)", rb"(\S+)", rb"(\S+)", NUMBER))),
}


# ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 bandwright\n{NAMES[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{line}{middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, payload: bytes, offset: int = 0, name: str = "-") -> bytes:
    """A URL record. Blanks and line ends, which part the fields, are percent-encoded in the url; what is encoded already stays as it is."""
    url = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url) or "-"
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {kind}{middle} {len(payload)}\n".encode() + payload + b"\n"


class Bytes:
    """Reads lines and counted bytes from gzip members or from plain bytes, without holding the whole file. Every byte is looked at once."""

    def __init__(self, source):
        self.source, self.inside, self.ahead, self.packed = source, None, bytearray(), None

    def more(self) -> bool:
        raw = b""
        if self.inside is not None and self.inside.eof:
            raw, self.inside = self.inside.unused_data, None
        if not raw and not (self.inside is not None and self.inside.unconsumed_tail):
            raw = self.source.read(1 << 16)
        if not raw:
            return False
        if self.packed is None:
            self.packed = raw[:2] == b"\x1f\x8b"
        if self.packed and self.inside is None:
            self.inside = zlib.decompressobj(31)
        self.ahead += self.inside.decompress(raw) if self.packed else raw
        return True

    def cut(self, size: int) -> bytes:
        out = bytes(memoryview(self.ahead)[:size])
        del self.ahead[:size]  # moves no byte behind it
        return out

    def line(self) -> bytes:
        """Up to and with the next line end; empty at the end of the file."""
        seen = 0
        while (i := self.ahead.find(b"\n", seen)) < 0:
            seen = len(self.ahead)
            if not self.more():
                return self.cut(seen)
        return self.cut(i + 1)

    def take(self, size: int) -> bytes:
        while len(self.ahead) < size and self.more():
            pass
        if len(self.ahead) < size:
            raise EOFError(f"the file ends {size - len(self.ahead)} bytes early")
        return self.cut(size)


def readable(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it is none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def arc_records(source) -> Iterator[tuple[dict[str, str] | None, bytes, str | None]]:
    """(fields, payload, error) of the URL records of an ARC file in order; the version block says how to read the lines.

    A url may hold blanks. Lines that are no record's come together as one entry without fields, whose payload they are and
    whose error says what is wrong; so does a payload that ends early. A file without a version block is one such entry.
    """
    data, version, lost = Bytes(source), None, []
    while line := data.line():
        if not line.strip():
            if lost:
                lost.append(line)
            continue
        line = line.rstrip(b"\r\n")
        if version is None:
            parts = line.split(b" ")
            try:
                body = data.take(int(parts[-1]))
                version = int(body.split(b" ", 1)[0])
            except (ValueError, EOFError):
                version = 0
            if not line.startswith(b"filedesc://") or version not in FIELDS:
                yield None, line, "no version block"
                return
            continue
        m = LINES[version].fullmatch(line)
        if m is None:
            lost.append(line + b"\n")
            continue
        if lost:
            yield None, b"".join(lost), "no record line"
            lost = []
        fields = dict(zip(FIELDS[version], map(readable, m.groups()), strict=True))
        try:
            yield fields, data.take(int(fields["length"])), None
        except EOFError as e:
            yield None, line, str(e)
            return
    if lost:
        yield None, b"".join(lost), "no record line"


# WARC


def warc_date(date: str) -> str:
    """ISO time of 14 digits; shorter ones are filled up with the least values."""
    date = (date + "00000101000000"[len(date) :])[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def warc_header(fields: dict[str, str], size: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items()]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {size}\r\n\r\n").encode()


def record_id(file: str, place: int) -> str:
    """Of the record at a place of an ARC file; each conversion gives it the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{place}')}>"


def warc_info(name: str) -> bytes:
    """The record that starts a file."""
    body = b"software: bandwright\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": warc_date("2020"), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return warc_header(fields, len(body)) + body + b"\r\n\r\n"


def converted(arc: dict[str, str], payload: bytes, own_id: str, key: str, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; with refers_to (record id, key) a revisit, which holds no payload. key: its number in the table it is from."""
    digest = hashlib.sha256(payload).hexdigest()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": own_id, "WARC-Date": warc_date(arc["date"]), "WARC-Target-URI": "".join(f"%{ord(c):02X}" if c <= " " else c for c in arc["url"]), "WARC-IP-Address": arc["ip"]}
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": arc["type"], "X-Payload-Length": str(len(payload)), "X-Record": key}
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to[0], "X-Refers-To": refers_to[1]}
        payload = b""
    fields["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    return warc_header(fields, len(payload)) + payload + b"\r\n\r\n"


def warc_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    data = Bytes(source)
    while line := data.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := data.line()).strip():
            key, _, value = line.decode().partition(":")
            fields[key] = value.strip()
        yield fields, data.take(int(fields["Content-Length"]))


class Members:
    """Writes records as gzip members into files of about FILE_BYTES, each with a name of its own."""

    def __init__(self, folder: str, ending: str):
        self.where, self.inside = fs.FileSystem.from_uri(folder)
        self.where.create_dir(self.inside, recursive=True)
        self.folder, self.ending, self.out, self.size = folder, ending, None, 0

    def roll(self) -> bool:
        """Opens the next file if the last is full; true if it did."""
        if self.out is not None and self.size < FILE_BYTES:
            return False
        self.close()
        self.name = f"{uuid.uuid4().hex}.{self.ending}"
        self.file, self.size = f"{self.folder}/{self.name}", 0
        self.out = self.where.open_output_stream(f"{self.inside}/{self.name}", compression=None)
        return True

    def write(self, record: bytes) -> None:
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(press.compress(record) + press.flush())
        self.size += len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


RECORDS = pa.schema([("file", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int64())])


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20200101000000") -> DataFrame:
    """Writes pages (page_id, url, html) as ARC files and returns a row for each record: (file, place, page_id, digest, size).

    Null html is an empty payload, a null or empty url is "-"; null and repeated ids are written as they come. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = Members(folder, "arc.gz"), 0
        for b in batches:
            rows = []
            urls = (u.decode() for u in texts_of(b.column(1)))
            for page_id, url, html in zip(b.column(0).to_pylist(), urls, texts_of(b.column(2)), strict=True):
                if files.roll():
                    files.write(arc_version_block(version, files.name, date))
                    place = 0
                files.write(arc_record(version, url, date, "text/html", html))
                rows.append((files.file, place, page_id, hashlib.sha256(html).digest(), len(html)))
                place += 1
            if rows:
                yield batch(RECORDS, **dict(zip(RECORDS.names, zip(*rows, strict=True), strict=True)))
        files.close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(rows.mapInArrow(run, "file string, place long, page_id long, digest binary, size long"))


def scan_arc(files: DataFrame) -> DataFrame:
    """(file, place, page_id, digest, size, error) of every entry of the ARC files of files (file); page_id is null, error null where the record is sound."""
    schema = pa.schema([*RECORDS, ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                where, inside = fs.FileSystem.from_uri(file)
                with where.open_input_stream(inside, compression=None) as source:
                    rows = [(file, i, None, hashlib.sha256(payload).digest(), len(payload), error) for i, (_, payload, error) in enumerate(arc_records(source))]
                if rows:
                    yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    files = files.select("file")
    return cut(files.repartition(min(max(1, files.count()), MOST_TASKS)).mapInArrow(run, "file string, place long, page_id long, digest binary, size long, error string"))


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT, by_place: bool = True) -> DataFrame:
    """Adds response_id, response_file and response_place: of equal payloads of at least min_bytes the record with the smallest page_id, null for that record itself and for others.

    Where no record of a payload has a page_id, as in scanned archives, the first by file and place is the response, unless
    by_place is false; else records without one are responses. Of rows that repeat the smallest page_id each is a response.
    """
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "place")
    least = records.where((F.col("size") >= min_bytes) & (F.lit(by_place) | F.col("page_id").isNotNull())).groupBy("digest").agg(F.min(key).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = least.withColumnRenamed("digest", "least_digest")
    met = records.join(least, F.col("digest") == F.col("least_digest"), "left")
    later = F.when(F.col("least.none"), F.struct("file", "place") > F.struct("least.file", "least.place")).otherwise(F.col("page_id") > F.col("least.page_id"))
    own = {f"response_{n}": F.when(later, F.col(f"least.{c}")) for n, c in (("id", "page_id"), ("file", "file"), ("place", "place"))}
    return met.withColumns(own).drop("least", "least_digest")


def convert(records: DataFrame, folder: str) -> DataFrame:
    """Converts the ARC files of records (file, place, page_id, response_...) and returns the WARC files: (file, records, errors).

    Entries of a file that are damaged are counted as errors and left out.
    """
    own = F.array_sort(F.collect_list(F.struct("place", "page_id", "response_id", "response_file", "response_place")))  # bounded by a file's records
    files = records.select("file").distinct().count()
    jobs = records.groupBy("file").agg(own.alias("own")).repartition(min(max(1, files), MOST_TASKS))  # small rows, but each is a file's work
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("errors", pa.int64())])
    text = lambda x: "None" if x is None else str(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, inside = fs.FileSystem.from_uri(file)
                files, known, sound, errors = Members(folder, "warc.gz"), {x["place"]: x for x in own}, 0, 0
                files.roll()
                files.write(warc_info(files.name))
                with where.open_input_stream(inside, compression=None) as source:
                    for place, (arc, payload, error) in enumerate(arc_records(source)):
                        if error is not None:
                            errors += 1
                            continue
                        x = known[place]
                        refers_to = None if x["response_file"] is None else (record_id(x["response_file"], x["response_place"]), text(x["response_id"]))
                        files.write(converted(arc, payload, record_id(file, place), text(x["page_id"]), refers_to))
                        sound += 1
                files.close()
                yield batch(schema, file=[files.file], records=[sound], errors=[errors])

    return cut(jobs.mapInArrow(run, "file string, records long, errors long"))


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, url, record_id, date, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of files (file)."""
    names = ("page_id", "url", "record_id", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    number = lambda x: None if x in (None, "None") else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                where, inside = fs.FileSystem.from_uri(file)
                with where.open_input_stream(inside, compression=None) as source:
                    rows, size = [], 0
                    for f, payload in warc_records(source):
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                        if f["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{f['WARC-Record-ID']}: the payload differs from its digest")
                        rows.append((number(f["X-Record"]), f["WARC-Target-URI"], f["WARC-Record-ID"], f["WARC-Date"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], number(f.get("X-Refers-To")), payload))
                        size += len(payload)
                        if size > 4 << 20:
                            yield batch(schema, **dict(zip(names, zip(*rows, strict=True), strict=True)))
                            rows, size = [], 0
                    if rows:
                        yield batch(schema, **dict(zip(names, zip(*rows, strict=True), strict=True)))

    files = files.select("file")
    return files.repartition(min(max(1, files.count()), MOST_TASKS)).mapInArrow(run, "page_id long, url string, record_id string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages to ARC files, those converted to WARC files, those read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, date).

    Every row comes back once: null html as an empty payload, null ids as null, repeated rows each.
    """
    folder = run_dir(pages.sparkSession, "archives")
    records = write_arc(pages, f"{folder}/arc", version)
    back = read_warc(convert(revisits(records, by_place=False), f"{folder}/warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > least THEN least END AS refers_to FROM m"""
