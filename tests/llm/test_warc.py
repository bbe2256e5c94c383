import base64
import gzip
import hashlib
import random
import time
import uuid

import pytest

from photocat.llm import warc


def record(payload: bytes, kind="response", digest=None, number=0):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(int=number)}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data):
    return [("gap", a, b) if x is None else (x["payload"], a, b) for x, a, b, _ in warc.salvage(data)]


def test_plain_and_gzip_members():
    parts = [record(b"one"), gzip.compress(record(b"two") + record(b"")), record(b"WARC/1.1\r\nnot a record\r\n\r\n" * 3), gzip.compress(record(b"three"))]
    data = b"".join(parts)
    assert [x for x, _, _ in parsed(data)] == [b"one", b"two", b"", b"WARC/1.1\r\nnot a record\r\n\r\n" * 3, b"three"]
    assert parsed(data)[-1][2] == len(data)
    assert parsed(b"") == []


def test_salvage_after_damage():
    good = [record(f"payload {k} ".encode() * 20, number=k) for k in range(6)]
    for broken, why in (
        (good[2][:-30], "cut short or length does not fit"),
        (good[2].replace(b"WARC/1.1", b"WARC/9.9", 1), "no version line"),
        (good[2].replace(b"payload 2", b"payload X", 1), "payload digest differs"),
        (good[2].replace(b"Content-Type: app", b"Content-Type app", 1), "header line without a colon"),
        (b"\x1f\x8b\x08 not gzip", "bad gzip member"),
        (gzip.compress(good[2])[:-9], "gzip member cut short"),
        (b"\0" * 100, "no version line"),
    ):
        data = b"".join([*good[:2], broken, *good[3:]])
        start, end = len(good[0] + good[1]), len(good[0] + good[1]) + len(broken)
        got = parsed(data)
        assert [x for x, _, _ in got] == [*(f"payload {k} ".encode() * 20 for k in range(2)), "gap", *(f"payload {k} ".encode() * 20 for k in range(3, 6))], why
        assert got[2][1:] == (start, end), why


def test_every_byte_is_a_record_or_a_gap():
    rng = random.Random(4)
    whole = b"".join(record(bytes(rng.randrange(256) for _ in range(rng.randint(0, 90)))) for _ in range(12))
    for _ in range(200):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 5)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        at = 0
        for _, a, b in parsed(bytes(data)):
            assert a == at
            at = b
        assert at == len(data)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        response = i == f
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response or f is None else "revisit", None if response else f))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a.example/", "<p>same</p>"), (5, "http://b.example/x y", "<p>same</p>"), (9, None, "<p>same</p>"), (-3, "u\r\nv", ""), (4, "u", None),
        (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "é", "text é 😀 \x00 \r\n\r\n"), (None, "u", "<p>same</p>"), (None, "u", "alone"), (9, "again", "<p>same</p>"), (2**62, "u", "big" * 100_000),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    warc.write(pages, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"))
    assert got.filter("gap is not null").count() == 0
    from pyspark.sql import functions as F

    cols = got.select(warc.number_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.number_of(F.col("refers_to")))
    assert sorted((tuple(r) for r in cols.collect()), key=str) == expected(rows)
    payloads = {bytes(r.payload).decode() for r in got.filter("record_type = 'response'").collect()}
    assert payloads == {h or "" for _, _, h in rows}


def test_damaged_file_through_spark(spark, tmp_path):
    good = [record(f"n{k}".encode(), number=k) for k in range(4)]
    (tmp_path / "x.warc").write_bytes(good[0] + good[1][:-7] + good[2] + good[3])
    rows = warc.read(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.gap is None, r.payload and bytes(r.payload)) for r in rows] == [(True, b"n0"), (False, None), (True, b"n2"), (True, b"n3")]
    assert rows[1].start == len(good[0]) and rows[1].end == len(good[0]) + len(good[1]) - 7


def test_a_long_address_is_no_damage():
    long = record(b"long", number=1).replace(b"Content-Type: app", b"WARC-Target-URI: http://a/" + b"x" * 200_000 + b"WARC/1.1\r\nContent-Type: app", 1)
    data = record(b"one") + long + record(b"three", number=3)
    assert [x for x, _, _ in parsed(data)] == [b"one", b"long", b"three"]
    # a header that does not end hides no record after it
    assert [x for x, _, _ in parsed(record(b"one") + b"WARC/1.1\r\nWARC-Type: response\r\n" + long)] == [b"one", "gap", b"long"]


@pytest.mark.parametrize("piece", [b"WARC/1.1\r\nA", b"WARC/1.1\r\nA:", b"WARC/1.1\r\nContent-Length: 0\r\nA", b"\x1f\x8b\x08ab"])
def test_eight_damaged_megabytes_take_seconds(piece):
    data, good = piece * ((8 << 20) // len(piece)), record(b"sound")
    began = time.monotonic()
    assert [x[0] for x in parsed(data + b"\r\n\r\n" + good)] == ["gap", b"sound"]
    assert parsed(data)[-1][2] == len(data)
    assert time.monotonic() - began < 60


def test_many_gzip_members_are_read_in_one_pass():
    data = gzip.compress(record(b"one of many" * 50)) * 20_000
    began = time.monotonic()
    assert len(parsed(data)) == 20_000
    assert time.monotonic() - began < 20
