import gzip
import hashlib
import os

import pytest
from oracle import same

from sealwright.llm.archive import ARC_FIELDS, arc_file_header, arc_record, convert, gzip_members, number_of, parse_arc, parse_warc, record_uuid, warc_record, warc_time
from sealwright.llm.queries import OP4_SQL, op4_warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"", b"a\n\nb", "é\r\n\r\nWARC/1.0".encode(), b"x" * 5000]
    data = arc_file_header(version, "f.arc", "20010101000000") + b"".join(arc_record(version, f"http://h/{i} q", "1.2.3.4", "20010203040506", "text/html", b) for i, b in enumerate(bodies))
    got = list(parse_arc(data))
    assert [r["content"] for r in got] == bodies and got[1]["URL"] == "http://h/1%20q" and set(ARC_FIELDS[version]) < set(got[0])
    with pytest.raises(ValueError):
        list(parse_arc(data[:-10]))
    with pytest.raises(ValueError):
        list(parse_arc(arc_record(version, "u", "i", "d", "m", b"z")))
    assert list(parse_arc(b"")) == []


def test_warc_records():
    for n in (0, 1, -5, 2**63 - 1, -(2**63)):
        assert number_of(f"<urn:uuid:{record_uuid(n)}>") == n
    assert warc_time("2009") == "2009-01-01T00:00:00Z" and warc_time("20090102030405") == "2009-01-02T03:04:05Z"
    text = b"".join(warc_record(i, "http://a/", "2009", "text/html", p, refers_to=r) for i, p, r in [(1, b"", None), (2, b"\r\n\r\nx\r\n\r\n", None), (3, b"q", 2)])
    got = list(parse_warc(text))
    assert [f["WARC-Type"] for f, _ in got] == ["response", "response", "revisit"] and got[1][1].endswith(b"\r\n\r\nx\r\n\r\n")
    with pytest.raises(ValueError):
        list(parse_warc(text[:-2]))


def test_gzip_members():
    parts = [b"", b"a" * 200_000, b"\0\0", bytes(range(256)) * 1000]
    data = b"".join(gzip.compress(p) + b"\0" * (i % 3) for i, p in enumerate(parts))
    assert list(gzip_members(data)) == parts
    with pytest.raises(ValueError):
        list(gzip_members(data[:-20]))


def test_hostile_urls_and_large_pages(spark, tmp_path):
    urls = ["filedesc://evil", "filedesc:", "http://a\tb\x00\x01\x0b\u2028", "a: b\r\nWARC/1.0", " ", "", "x" * 100_000, "WARC/1.0"]
    rows = [(i, u, "p") for i, u in enumerate(urls)] + [(100, "big", "z" * (17 << 20)), (101, "big", "z" * (17 << 20)), (102, "odd", "\0" * 5000)]
    path = str(tmp_path / "w")
    got = {r.page_id: r for r in convert(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path).collect()}
    assert {i: r.payload_digest for i, r in got.items()} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows} and len(got) == len(rows)
    assert got[100].refers_to == 101 and got[101].record_type == "response"
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    whole = b"".join(gzip.decompress(open(os.path.join(path, f), "rb").read()) for f in files)  # any gzip reader reads them
    assert len(list(parse_warc(whole))) == len(rows)


def test_pages_with_odd_rows(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a b/\n", big, "x"), (5, None, big, "x"), (3, "u", big, "x"), (4, "u", None, "x"), (6, "u", "", "x"), (7, "u", "y" * 999, "x"), (8, "u", "y" * 999, "x"), (None, "u", big, "x"), (9, "u", "\r\n\r\nWARC/1.0\r\n" * 100, "x"), (9, "u", "\r\n\r\nWARC/1.0\r\n" * 100, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = convert(df, str(tmp_path / "w")).collect()
    want = []
    for i, _, h, _ in rows:
        if i is None:
            continue
        b = (h or "").encode()
        newest = max(j for j, _, x, _ in rows if j is not None and (x or "").encode() == b)
        ref = newest if len(b) >= 1000 and newest > i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert convert(df.limit(0), str(tmp_path / "e")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(op4_warc(spark, d), OP4_SQL, d)
