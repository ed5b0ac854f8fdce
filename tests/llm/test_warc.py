import base64
import gzip
import hashlib
import io

import pytest

from timberline.llm.warc import member, op6_warc, read_warc, record, records, write_warc


def expected(rows):
    first = {}
    for page_id, html in rows:
        key = (html or "").encode()
        if page_id is not None:
            first[key] = min(first.get(key, page_id), page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = to is not None and (page_id is None or page_id > to)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert sorted(map(tuple, op6_warc(spark, d).collect()), key=str) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(5, "http://a b\n/ü", "same"), (2, None, "same"), (2, None, "same"), (9, "u", None), (7, "u", ""), (None, "u", "same"), (None, "v", "alone"), (11, "w", "x\r\n\r\n" * 100000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    folder = write_warc(df, folder=str(tmp_path / "archives"))
    back = read_warc(spark, folder).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=str) == expected([(r[0], r[2]) for r in rows])
    assert {bytes(r.payload) for r in back if r.record_type == "response"} == {b"same", b"", b"alone", b"x\r\n\r\n" * 100000}
    n = 0
    for f in (tmp_path / "archives").glob("part-*"):  # one member per record
        data = f.read_bytes()
        n += gzip.decompress(data).count(b"WARC/1.1\r\n")
        assert data.count(b"\x1f\x8b\x08") >= gzip.decompress(data).count(b"WARC/1.1\r\n")
    assert n == len(rows)
    assert read_warc(spark, write_warc(df.limit(0))).count() == 0


def test_revisits_and_hot_payloads(spark):
    """A third of all pages have one payload; there are pairs, empty and null ones."""
    rows = [(i, f"http://h/{i}", "hot page " * 50 if i % 3 == 0 else f"page {i // 4}" if i % 3 == 1 else f"own {i}" if i % 7 else [None, ""][i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    back = read_warc(spark, write_warc(df)).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=str)
    assert got == expected([(r[0], r[2]) for r in rows]) and sum(r.record_type == "revisit" for r in back) > 200
    body = {r.payload_digest: bytes(r.payload) for r in back if r.payload is not None}
    assert all(body[r.payload_digest].decode() == (rows[r.page_id][2] or "") for r in back)


def test_large_records_are_followed_by_an_empty_member():
    big = record(1, "http://x/", b"ab" * (9 << 20), None)
    data = member(big) + member(record(2, "http://y/", b"small", None)) + member(big)
    assert member(big)[-1] == 0 and gzip.decompress(data).count(b"WARC/1.1") == 3
    assert [(r["page_id"], len(r["payload"])) for r in records(io.BytesIO(data), True)] == [(1, 18 << 20), (2, 5), (1, 18 << 20)]


def test_damage_is_found():
    good = record(1, "http://x/", b"some payload", None)
    assert [r["payload"] for r in records(io.BytesIO(gzip.compress(good)), True)] == [b"some payload"]
    for bad in (good.replace(b"some", b"same"), good[:-1], good.replace(b"WARC/1.1", b"WARC/0.9"), good + b"x"):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(gzip.compress(bad)), True))
    with pytest.raises(ValueError):
        list(records(io.BytesIO(gzip.compress(good)[:-12]), True))
