"""Operator 5: exact round trips, push-down, splits and foreign archives."""

import base64
import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyarrow import fs

from isospark.llm import queries, warc

SF = "/root/testdata/sf0.001"


def plain(pages, least=0):
    first = {}
    for i, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in pages:
        b = (h or "").encode()
        low = first.get(h or "")
        again = i != low and len(b) >= least
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


def test_query(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op5_warc(spark, SF).collect()), key=str) == plain(pages)


AWKWARD = [(1, "http://a\r\nX: y", None), (2, None, ""), (3, "u", "é" * 70_000), (4, "u", "WARC/1.1\r\n\r\n\x1f\x8b"), (5, "v", "é" * 70_000), (None, "w", "x"), (6, "w", "x"), (6, "w", "x")]


@pytest.mark.parametrize("split,roll", [(1 << 27, 1 << 30), (700, 1500)])
def test_round_trip(spark, tmp_path, split, roll):
    rng = random.Random(1)
    more = [(100 + i, f"http://h/{i}", "".join(chr(rng.randint(1, 2000)) for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    pages = spark.createDataFrame([(*r, "z") for r in AWKWARD + more], "page_id long, url string, html string, sha string")
    path = f"file://{tmp_path}/a"
    warc.write(warc.records(pages), path, rollBytes=roll)
    rows = warc.read(spark, path, splitBytes=split).collect()
    got = []
    for r in rows:
        i, to = (int(u[10:-1]) if u and u[10:-1] != "none" else None for u in (r.record_id, r.refers_to))
        got.append((i, r.payload_bytes, r.payload_digest, r.record_type, to))
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert sorted(got, key=str) == plain([(i, h) for i, _, h in AWKWARD + more])
    assert {r.target_uri for r in rows if r.record_id == "<urn:page:1>"} == {"http://a%0D%0AX: y"}

    def heads():
        return warc.read(spark, path, payload=False, splitBytes=split)

    assert heads().where("record_type = 'revisit' and payload_bytes > 10").count() == 1
    assert heads().where("target_uri is null or not target_uri like 'http%'").count() == len(AWKWARD) - 1
    assert heads().where("refers_to <> '<urn:page:3>'").count() == sum(r[4] not in (None, 3) for r in got)


def test_filters_skip_payloads(tmp_path):
    path = str(tmp_path / "x.warc.gz")
    with open(path, "wb") as f:
        for i in range(20):
            f.write(warc.encode({"record_type": "response" if i % 2 else "revisit", "record_id": f"<urn:page:{i}>", "date": "d", "payload_digest": "x", "payload_bytes": 200_000, "refers_to": "<r>", "payload": random.Random(i).randbytes(200_000)}))
    file, _ = fs.LocalFileSystem().open_input_file(path), None
    stats = warc._Stats()
    rows = list(warc.scan(file, 0, 1 << 40, lambda r: r["record_id"].endswith(":3>"), True, stats))
    assert [len(r["payload"]) for r in rows] == [200_000]
    assert stats.records == 20 and stats.payloads == 1 and stats.skipped_bytes > 9 * 190_000


def test_foreign_archive(spark, tmp_path):
    raw = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <a>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(raw % b"resource") + gzip.compress(raw % b"metadata") + gzip.compress(raw % b"resource"))
    df = warc.read(spark, f"file://{tmp_path}", splitBytes=10)
    assert [(r.record_type, r.payload) for r in df.collect()] == [("resource", b"hello"), ("metadata", b"hello"), ("resource", b"hello")]
    assert warc.read(spark, f"file://{tmp_path}").where("record_type = 'metadata'").count() == 1


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    warc.write(warc.records(pages), path)
    (tmp_path / "b" / "part-lost.warc.gz").write_bytes(b"half a rec")
    warc.write(warc.records(pages), path)
    assert warc.read(spark, path).count() == 2
    warc.write(warc.records(pages), path, mode="overwrite")
    assert warc.read(spark, path).count() == 1


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records(pages), f"file://{tmp_path}/c")
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0
    assert warc.records(spark.createDataFrame([(1, None, "ab"), (2, None, "ab")], "page_id long, url string, html string"), least=3).where("record_type = 'revisit'").count() == 0
    assert pa.__version__
