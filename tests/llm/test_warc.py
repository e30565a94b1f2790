from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from shoebox.llm import warc

PAGES = [
    (1, "http://a.example/1", b"same"),
    (2, "http://a.example/2", b"same"),
    (3, "http://a.example/3", b"other \r\n\r\n WARC/1.1\r\n"),
    (4, None, b""),
    (5, "http://a.example/5\r\nX: y", None),
    (6, "http://a.example/6", bytes(range(256)) * 3000),
    (6, "http://a.example/6", bytes(range(256)) * 3000),
    (None, "http://a.example/7", b"\x1f\x8b\x08 unique"),
    (None, "http://a.example/8", b"nulls"),
    (9, "http://é.example/9", b"nulls"),
]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload or b"").digest()).decode()


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    rows = spark.createDataFrame(PAGES, "page_id BIGINT, target_uri STRING, payload BINARY").repartition(3)
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    warc.write_archive(warc.with_revisits(rows.withColumn("record_id", name), "page_id"), path, split_bytes="2000")
    return path


def test_round_trip(spark, archive):
    rows = warc.read_archive(spark, archive).collect()
    assert len(rows) == len(PAGES)
    got = sorted((r.record_type, r.record_id, r.refers_to or "", r.payload_digest, bytes(r.payload)) for r in rows)
    want = []
    for i, _, p in PAGES:
        p = p or b""
        peers = [j for j, _, q in PAGES if (q or b"") == p and j is not None]
        last = max(peers, default=None)
        again = last is not None and i != last
        want.append(("revisit" if again else "response", f"urn:page:{'none' if i is None else i}", f"urn:page:{last}" if again else "", digest(p), b"" if again else p))
    assert got == sorted(want)


def test_headers_and_pushdown(spark, archive):
    from pyspark.sql import functions as F

    heads = warc.read_archive(spark, archive, payload=False)
    assert "payload" not in heads.columns and heads.count() == len(PAGES)
    assert {r.target_uri for r in heads.collect()} >= {"http://a.example/5%0D%0AX: y", "http://é.example/9", None}
    some = warc.read_archive(spark, archive).where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a.example/1"))
    assert [r.record_id for r in some.collect()] == ["urn:page:1"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # all of it went into the scan
    assert heads.where(F.col("refers_to").isNull()).count() == heads.where(~F.col("refers_to").isNotNull()).count()
    assert heads.where(~(F.col("target_uri") == "http://a.example/1")).count() == len(PAGES) - 2
    assert heads.where(F.col("record_id").isin("urn:page:3", "urn:page:4") & F.col("payload_length").isNotNull()).count() == 2


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_unwanted_payloads_are_skipped():
    import os

    big = warc.record("response", "urn:a", "http://a", os.urandom(3_000_000), None, "2024-01-01T00:00:00Z")
    small = warc.record("revisit", "urn:b", "http://b", b"", "urn:a", "2024-01-01T00:00:00Z")
    for data in (warc.member(big) + warc.member(small), big + small):
        file = Counting(data)
        rows = list(warc.scan(file, len(data), lambda r: r["record_type"] == "revisit", True))
        assert [r["record_id"] for r, _ in rows] == ["urn:b"]
        assert file.taken < 300_000


def test_archives_of_others():
    one = warc.record("response", "urn:a", "http://a", b"one" * 50_000, None, "2024-01-01T00:00:00Z")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for data in (gzip.compress(info) + gzip.compress(one), info + one, warc.member(info) + one):
        for keep in (True, False):
            rows = list(warc.scan(io.BytesIO(data), len(data), lambda r: True, keep))
            assert [(r["record_type"], p) for r, p in rows] == [("warcinfo", b"hello" if keep else None), ("response", b"one" * 50_000 if keep else None)]
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(b"no archive"), 10, lambda r: True, True))


def test_failed_attempts_and_appends(spark, archive, tmp_path):
    path = f"file://{tmp_path}/b"
    rows = warc.read_archive(spark, archive)
    warc.write_archive(rows, path)
    warc.write_archive(rows, path)
    (tmp_path / "b" / "part-left-behind.warc.gz").write_bytes(b"\x1f\x8b broken")
    assert warc.read_archive(spark, path).count() == 2 * len(PAGES)
    empty = f"file://{tmp_path}/c"
    warc.write_archive(rows.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_small_payloads_stay_responses(spark):
    rows = spark.createDataFrame([(k, f"r{k}", None, b"tiny") for k in range(3)], "page_id BIGINT, record_id STRING, target_uri STRING, payload BINARY")
    assert {r.record_type for r in warc.with_revisits(rows, "page_id", min_bytes=5).collect()} == {"response"}
    assert sum(r.record_type == "revisit" for r in warc.with_revisits(rows, "page_id", min_bytes=4).collect()) == 2


def test_base32(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(bytes([k]) * k,) for k in range(60)], "b BINARY").select("b", warc.base32_sha1(F.col("b")).alias("d"))
    assert all(r.d == digest(bytes(r.b)) for r in rows.collect())


class Requests(Counting):
    asked = 0

    def read(self, n=-1):
        self.asked += 1
        return super().read(n)


def test_small_records_share_requests():
    records = [warc.member(warc.record("response" if k % 3 else "revisit", f"urn:{k}", None, b"%d " % k * 200, None, "2024-01-01T00:00:00Z")) for k in range(3000)]
    data = b"".join(records)
    for payloads in (True, False):
        file = Requests(data)
        rows = list(warc.scan(file, len(data), lambda r: r["record_type"] == "response", payloads))
        assert [r["record_id"] for r, _ in rows] == [f"urn:{k}" for k in range(3000) if k % 3]
        assert file.asked <= 2 + len(data) // (warc.READ_BYTES - warc.PIECE) and file.taken <= len(data) * 1.4
        assert not payloads or all(p == b"%d " % int(r["record_id"][4:]) * 200 for r, p in rows)
