import base64
import hashlib
import io

import pytest

from heddle.llm.common import scratch
from heddle.llm.warc import WarcError, base32_sha1, read_archives, read_records, record_bytes, warc_round_trip, write_archives

SCHEMA = "page_id long, url string, html string, payload int"


def digest(b):
    return base32_sha1(hashlib.sha1(b).digest())


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        f = first.get(h or "")
        refers = f if f is not None and f != p else None
        b = (h or "").encode()
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


ROWS = [(i, f"http://h/{i} é", "<p>é</p>" * (i % 5)) for i in range(40)] + [(50, None, None), (51, "x\r\ny", "big" * 200_000), (52, "u", "big" * 200_000), (None, "u", "<p>é</p>"), (None, "u", "alone"), (7, "u", "<p>é</p>" * 2)]


@pytest.mark.parametrize("least", [0, 17])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(pages, least).collect()]
    assert sorted(got, key=repr) == brute(ROWS, least)


def test_payloads_urls_and_rolled_archives(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS if r[0] is not None], SCHEMA)
    manifest = write_archives(pages, scratch(spark, "warc"), archive_bytes=700)
    assert manifest.count() > 8
    got = {r.page_id: r for r in read_archives(manifest).where("record_type = 'response'").collect()}
    assert bytes(got[51].payload) == b"big" * 200_000 and got[0].payload == b"" and got[3].url == "http://h/3 é"
    assert warc_round_trip(pages.where("false")).count() == 0


def record(payload=b"<html>hello</html>" * 50):
    return record_bytes("response", "urn:page:1", "http://a", payload, digest(payload), None)


def test_reader_is_strict():
    good = record() + record(b"")
    assert [r.payload_bytes for r in read_records(io.BytesIO(good))] == [900, 0]
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(good[:-9])))
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(record_bytes("response", "urn:page:1", "u", b"abc", digest(b"abd"), None))))
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(b"no gzip here")))
    broken = bytearray(good)
    broken[60] ^= 255
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(bytes(broken))))
    assert list(read_records(io.BytesIO(b""))) == []
