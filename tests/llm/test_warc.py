"""Archives written and read back: against plain Python, with magic lines and whole records inside payloads."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from threatlens.llm import warc as W
from threatlens.llm.queries import QUERIES

from .conftest import SF, documents

FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999:X>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\n"
        "hello\r\n\r\n")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, min_bytes=0):
    """(page_id, html) -> page_id, payload_bytes, payload_digest, record_type, refers_to."""
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= min_bytes and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        at = first.get(data)
        out.append((i, len(data), sha1(data), *(("response", None) if at is None or at == i else ("revisit", at))))
    return sorted(out, key=str)


def trip(spark, rows, tasks=3, min_bytes=0):
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if k % 2 else None, h, "c", "d") for k, (i, h) in enumerate(rows)],
                               "page_id long, url string, html string, first string, n string").repartition(tasks)
    got = W.round_trip(df, min_bytes).collect()
    assert all(r.intact for r in got)
    page = lambda x: None if x is None or x.split(":")[2] == "" else int(x.split(":")[2])
    return sorted(((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in got), key=str)


ROWS = [(1, "<p>one</p>"), (2, "<p>one</p>"), (3, None), (4, ""), (9, "two"), (5, "two"), (5, "two"), (None, "two"), (None, "alone"), (None, "alone"),
        (20, "WARC/1.1\r\n"), (21, "WARC/1.1\r\nWARC/1.1\r\n"), (22, "a WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n" + FAKE + FAKE), (23, FAKE * 40), (24, FAKE * 40),
        (25, "\r\n\r\n" * 30), (26, "WARC/1.1\r\n" * 500 + "end"), (27, "Ünï 日本 \x00  "), (28, "x" * 300_000), (29, "\r\n\r\nWARC/1.1"), (30, "\r\n")]


def test_sha1_base32(spark):
    values = [b"", b"abc", b"\xff\x00" * 77, bytes(range(256))]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "v binary")
    assert [r[0] for r in df.select(W.sha1_base32(F.col("v"))).collect()] == [sha1(v) for v in values]


@pytest.mark.parametrize("split", [300, 2000])
def test_round_trip_with_splits_anywhere(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    rows = [(i, h[:20_000] if h else h) for i, h in ROWS]
    try:
        assert trip(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_payloads_are_no_revisits(spark):
    assert trip(spark, ROWS, 2, 8) == brute(ROWS, 8)


def test_lookups_too_large_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(W, "HOT_PARTS", 4)
    rows = ROWS + [(100 + i, "hot page") for i in range(60)]
    assert trip(spark, rows) == brute(rows)


def test_several_scans(spark, monkeypatch):
    monkeypatch.setattr(W, "SPLITS_PER_SCAN", 2)
    assert trip(spark, ROWS, 7) == brute(ROWS)


def test_payload_of_any_bytes(spark, tmp_path):
    data = bytes(range(256)) * 20 + b"WARC/1.1\r\n" + b"\xff\xfe\r\n\r\n"
    df = spark.createDataFrame([(1, "u", bytearray(data))], "page_id long, url string, html binary")
    W.write_archives(df, str(tmp_path / "a"))
    r = W.read_archives(spark, str(tmp_path / "a")).collect()
    assert [bytes(x.payload) for x in r] == [data] and r[0].uri == "u" and r[0].complete


def test_broken_archive_is_told(spark, tmp_path):
    rows = [(i, "url", f"<p>{i}</p>" * 50) for i in range(20)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    [file] = (tmp_path / "a").glob("part-*")
    data = file.read_bytes()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "cut.warc").write_bytes(data[:len(data) * 2 // 3])
    with pytest.raises(ValueError):
        W.read_archives(spark, str(tmp_path / "b"))
    kept = W.read_archives(spark, str(tmp_path / "b"), broken="keep").collect()
    assert 10 < len(kept) < 16 and sum(not r.complete for r in kept) <= 1


def test_empty_table(spark):
    assert trip(spark, []) == []


def test_query(spark):
    rows = [(r.page_id, r.html) for r in documents(spark, "pages").collect()]
    got = QUERIES["op12_warc_archives"](spark, SF).collect()
    assert all(r.intact for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
