import base64
import hashlib
import random

import pytest

from lexiloom.llm import warc
from lexiloom.session import shared_path

ODD = [
    (5, "http://a/ b\r\nX: y", "<p>é😀</p>" * 900), (2, None, "<p>é😀</p>" * 900), (9, "http://c", "<p>é😀</p>" * 900), (1, "u", None), (3, "u", ""), (None, "u", "same"), (7, "u", "same"), (None, "u", "alone"),
    (8, "u", "twice"), (8, "u", "twice"), (8, "u", "other"), (11, "u", "x\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (12, "u", "y" * 5000), (12, "u", "y" * 5000), (13, "u", "😀" * 3000),
]


def brute(pages, minimum=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    found = []
    for p, _, h in pages:
        size = len((h or "").encode())
        same = [q for q, _, g in pages if (g or "") == (h or "") and q is not None]
        first = min(same) if same and len([1 for _, _, g in pages if (g or "") == (h or "")]) > 1 and size >= minimum else None
        again = first is not None and (p is None or p > first)
        found.append((p, size, digest(h), "revisit" if again else "response", first if again else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("segment,chunk,compression,minimum", [(300, 100, "none", 0), (300, 7, "gzip", 6), (100_000, 8192, "none", 0)])
def test_pages_come_back(spark, segment, chunk, compression, minimum):
    path = shared_path(spark, "warc-test")
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, path, minimum=minimum, segment_bytes=segment, chunk_bytes=chunk, compression=compression, records_per_archive=40)
    records = warc.read_warc(spark, path)
    assert sorted(map(tuple, warc.listed(records).collect()), key=str) == brute(ODD, minimum)
    whole = {r.payload.decode() for r in records.where("record_type = 'response'").collect()}
    assert whole == {h or "" for _, _, h in ODD}


def test_broadcast_and_shuffle_agree(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    test_pages_come_back(spark, 300, 100, "none", 0)


def test_segments_with_gaps_or_wrong_length_have_no_payload(spark, tmp_path):
    rng = random.Random(1)
    page = "".join(rng.choice("abc") for _ in range(900))
    digest = "D" * 32
    records = list(warc.records_of(1, "u", page, digest, None, False, segment_bytes=200, chunk_bytes=64))
    for name, kept in (("whole", records), ("gap", records[:2] + records[3:]), ("cut", records[:-1]), ("long", [records[0], *records[1:-1], records[-1].replace(b"Total-Length: ", b"Total-Length: 1")])):
        (tmp_path / name).mkdir()
        rng.shuffle(kept)
        (tmp_path / name / "part-0.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in kept))
        found = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert [r.payload.decode() if r.payload is not None else None for r in found] == [page if name == "whole" else None]


def test_chunks():
    for data in (b"", b"abc", "é😀".encode() * 99):
        assert warc.dechunked(warc.chunked(data, 5)) == data
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"3\r\nabc\r\n") is None


def test_empty_table(spark):
    path = shared_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.listed(warc.read_warc(spark, path)).count() == 0
