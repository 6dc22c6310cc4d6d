from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from rankloom.llm import warc
from tests.oracle import rows_of, rows_of_sql

PAGES = [
    (3, "http://a/é\r\nX: y", "same"), (1, None, "same"), (2, "http://b", "same"), (4, "http://c", None), (5, "u", ""), (6, "u", "other \r\n\r\n text é 😀"),
    (None, "http://n", "same"), (None, "http://n", "alone"), (1, None, "same"), (7, "u", "x" * 300_000), (8, "u", "WARC/1.1\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, size int, sha1 string")


def expected(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        original = first.get(h or "")
        revisit = original is not None and original != p
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(map(str, out))


def read(manifest):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.read_warc(manifest).collect())


@pytest.mark.parametrize("least,roll,shards", [(0, 1 << 30, 3), (4, 1, 2), (5, 300, 1)])
def test_roundtrip(spark, tmp_path, least, roll, shards):
    manifest = warc.write_warc(pages(spark), str(tmp_path / "w"), least=least, roll=roll, shards=shards)
    assert read(manifest) == expected(PAGES, least)
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(manifest).where("record_type = 'response' and page_id is not null").collect()}
    assert payloads[6] == PAGES[5][2] and payloads[7] == PAGES[9][2] and payloads[8] == PAGES[10][2]
    if roll == 1:
        assert manifest.count() == len(PAGES)


def test_files_are_deterministic_and_named_in_the_manifest(spark, tmp_path):
    found = []
    for name, parts in (("a", 1), ("b", 5)):
        manifest = warc.write_warc(pages(spark).repartition(parts), str(tmp_path / name), shards=2)
        found.append(sorted((r.file.rsplit("/", 1)[1], r.records, r.bytes, r.sha1) for r in manifest.collect()))
        for r in manifest.collect():
            data = open(r.file, "rb").read()
            assert len(data) == r.bytes and hashlib.sha1(data).hexdigest() == r.sha1
            text = gzip.decompress(data)
            assert text.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in text.replace(b"%0D%0A", b"")
        assert not list((tmp_path / name).glob("*.tmp"))
    assert found[0] == found[1]


def test_records_are_in_order_of_ids(spark, tmp_path):
    manifest = warc.write_warc(pages(spark), str(tmp_path / "w"), shards=1)
    ids = [h.get("X-Page-Id") for h, _ in warc.decode_records(iter([open(manifest.first().file, "rb").read()]))]
    assert ids == sorted(ids, key=lambda x: (x is not None, int(x or 0)))


def test_damage_is_found(spark, tmp_path):
    manifest = warc.write_warc(pages(spark), str(tmp_path / "w"), shards=1)
    path = manifest.first().file
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception):
        warc.read_warc(manifest).collect()


def test_empty(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, []), str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_warc(manifest).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(warc.op8_warc(spark, sf)) == rows_of_sql(warc.SQL["op8_warc"], sf)
