"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writing: one record a row, built from columns and written with Spark's text writer, whose line separator is the
second of the two line ends that close a record; so the files are plain WARC 1.1 in any store Spark can write to. Of
rows with equal payloads the one with the largest id is a response, the others are revisit records that refer to it.

Reading: every record must pass its checks (version line, header, length, closing line ends, payload digest). After
a failed check the reader searches the next version line or gzip member from which a record passes, goes on there,
and reports the bytes between as a quarantined gap with its place and reason. Files hold about ``FILE_BYTES``.

Defined results: a null payload is the empty payload; a null id has a record id of its own, is never referred to if
another row has the same payload, and is read back as null; a null address is left out of the header, line ends in
an address are written as spaces; repeated rows are written as often as they stand (rows with the largest id of their
payload are all responses); an empty table gives no records; further columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import fixed, small_or_plain, table
from photocat.session import work_dir

FILE_BYTES = 8 << 20
#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "ffffffff-ffff-8fff-bfff-ffffffffffff"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from the hexadecimal form: five hexadecimal digits are four of base32."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(number: Column) -> Column:
    h = F.lower(F.lpad(F.hex(number), 16, "0"))
    made = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8000-8000-00000000"), F.substring(h, 13, 4))
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(made, F.lit(NO_ID)), F.lit(">"))


def number_of(uuid: Column) -> Column:
    """The id from which a record id was made."""
    h = F.concat(F.substring(uuid, 11, 8), F.substring(uuid, 20, 4), F.substring(uuid, 43, 4))
    # two halves, as a 64-bit number with its sign
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.when(uuid == f"<urn:uuid:{NO_ID}>", None).otherwise(F.shiftleft(high, 32) + low)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value): one WARC record a row without its last line end. ``pages``: page_id, url, html."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", digest(F.col("html").cast("binary")))
    p = p.withColumn("bytes", F.octet_length("html"))
    many = p.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    p = p.join(small_or_plain(fixed(many)), "digest", "left")
    p = p.withColumn("revisit", (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    p = p.withColumn("http", http).withColumn("block", F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "html")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _uuid(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        F.coalesce(line("WARC-Target-URI", F.translate(F.col("url"), "\r\n", "  ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", _uuid(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return p.select(F.concat(header, F.lit("\r\n"), F.col("block"), F.lit("\r\n")).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the pages as archives of about FILE_BYTES each."""
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    rows = max(1, int(FILE_BYTES / (size + 700)))
    records(pages, min_bytes).write.option("lineSep", "\r\n").option("maxRecordsPerFile", rows).text(path)


class BadRecord(ValueError):
    pass


VERSION = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
#: An empty line, or the version line of another record before one.
HEADER_END = re.compile(rb"\r\n(?:(\r\n)|WARC/1\.[01]\r\n)")


#: Bytes of a gzip member that are inflated at once: few at first, as most places to try are none.
INFLATE_FIRST, INFLATE_MOST = 1 << 10, 1 << 20


class _Header:
    """The fields before one header end, read once: the last line of each name counts."""

    def __init__(self, data: bytes, at: int, end: int):
        self.end, self.start = end, end + 4
        self.last, self.bad, self.digests = {}, -1, {}
        line = data.find(b"\r\n", at, end)
        while line >= 0:
            stop = data.find(b"\r\n", line + 2, end)
            name, colon, value = data[line + 2 : end if stop < 0 else stop].partition(b":")
            if colon:
                self.last[name.strip().lower()] = line, value.strip().decode("utf-8", "replace")
            else:
                self.bad = line
            line = stop

    def get(self, name: bytes, at: int) -> str | None:
        line, value = self.last.get(name, (-1, None))
        return value if line > at else None


class Records:
    """The records in one run of bytes. Places to try come in ascending order; those before the same header end share its
    fields and its block, so each end is looked for and read once, and a damaged file takes time in proportion to its size."""

    def __init__(self, data: bytes):
        self.data, self.header = data, None
        self.since, self.next_end = len(data) + 1, None  # the first header end behind ``since``

    def _header(self, at: int) -> _Header:
        if at < self.since or self.next_end and self.next_end.start() < at:
            self.since, self.next_end = at, HEADER_END.search(self.data, at)
        if not self.next_end or not self.next_end[1]:
            raise BadRecord("header does not end")
        if not self.header or self.header.end != self.next_end.start() or at < self.since:
            self.header = _Header(self.data, at, self.next_end.start())
        return self.header

    def one(self, at: int) -> tuple[dict, int]:
        """The plain record at ``at`` and where it ends."""
        data = self.data
        if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
            raise BadRecord("no version line")
        header = self._header(at)
        if header.bad > at:
            raise BadRecord("header line without a colon")
        length = header.get(b"content-length", at) or ""
        if not length.isdecimal():
            raise BadRecord("no length")
        stop = header.start + int(length)
        if stop + 4 > len(data):
            raise BadRecord("cut short")
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise BadRecord("length does not fit")
        kind = header.get(b"warc-type", at) or ""
        stated = (header.get(b"warc-payload-digest", at) or "").removeprefix("sha1:")
        http = (header.get(b"content-type", at) or "").startswith("application/http")
        split = data.find(b"\r\n\r\n", header.start, stop) if http else header.start - 4
        head_end, body = (stop, stop) if split < 0 else (split, split + 4)
        if kind != "revisit" and stated:
            if body not in header.digests:
                header.digests[body] = base64.b32encode(hashlib.sha1(memoryview(data)[body:stop]).digest()).decode()
            if stated != header.digests[body]:
                raise BadRecord("payload digest differs")
        size = stop - body
        if kind == "revisit":
            fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(b":") for x in data[header.start : head_end].split(b"\r\n")[1:])} if http else {}
            told = fields.get(b"content-length", b"")
            size = int(told) if told.isdigit() else None
        found = {
            "record_type": kind, "record_id": header.get(b"warc-record-id", at), "target_uri": header.get(b"warc-target-uri", at), "payload_digest": stated,
            "payload_bytes": size, "refers_to": header.get(b"warc-refers-to", at), "payload": None if kind == "revisit" else data[body:stop],
        }
        return found, stop + 4

    def at(self, at: int) -> tuple[list[dict], int]:
        """The record, or the records of the gzip member, at ``at`` and where they end."""
        if self.data[at : at + 2] != b"\x1f\x8b":
            found, end = self.one(at)
            return [found], end
        plain, end = _inflated(self.data, at)
        inner, out, k = Records(plain), [], 0
        while k < len(plain):
            found, k = inner.one(k)
            out.append(found)
        return out, end


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where it ends; no more of the data is read than the member has."""
    member, out, size = zlib.decompressobj(31), [], INFLATE_FIRST
    while not member.eof:
        if at >= len(data):
            raise BadRecord("gzip member cut short")
        try:
            out.append(member.decompress(data[at : at + size]))
        except zlib.error as e:
            raise BadRecord("bad gzip member") from e
        at, size = at + size, min(4 * size, INFLATE_MOST)
    return b"".join(out), min(at, len(data)) - len(member.unused_data)


def salvage(data: bytes):
    """(record or None, start, end, reason) for every record, and for every gap between records that pass."""
    at, records = 0, Records(data)
    while at < len(data):
        try:
            found, end = records.at(at)
            yield from ((x, at, end, None) for x in found)
            at = end
            continue
        except BadRecord as e:
            why, gap = str(e), at
        at = len(data)
        for m in VERSION.finditer(data, gap + 1):
            try:
                records.at(m.start())
            except BadRecord:
                continue
            at = m.start()
            break
        yield None, gap, at, why


COLUMNS = ("record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload")
SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), *[(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS]])
DDL = "path string, start bigint, end bigint, gap string, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record, and one per quarantined gap, whose ``gap`` tells the reason and whose record columns are
    null. ``payloads=False`` checks the payloads and leaves them out."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for found, start, end, why in salvage(data.as_py()):
                    row = dict.fromkeys(COLUMNS) | (found or {}) | {"path": name.as_py(), "start": start, "end": end, "gap": why}
                    rows.append(row if payloads else row | {"payload": None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DDL)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records read back from archives of all pages."""
    path = f"{work_dir(spark)}/warc"
    write(table(spark, sf_dir, "pages"), path)
    got = read(spark, path, payloads=False).filter("gap is null")
    return got.select(number_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number_of(F.col("refers_to")).alias("refers_to"))


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages
), d AS (
  SELECT page_id, html, list_reduce(list_transform(range(0, 32), lambda i: substr('{BASE32}',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), lambda a, b: a || b) AS digest FROM p
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM d
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM w
"""
