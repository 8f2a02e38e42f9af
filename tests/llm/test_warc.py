"""Archives written, normalised and read back, against the rows they were made of."""

import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm import warc

SF = "/root/testdata/sf0.001"
LONG = "<p>long</p>" * 200_000
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("Payload", T.StringType())])
ODD = [
    (5, "http://a/ b\r\nWARC-Type: x", "x" * 99), (6, None, "x" * 99), (9, "http://é/", "é" * 50), (8, "u", "é" * 50), (8, "u", "é" * 50), (None, "n", "é" * 50), (10, "v", "é" * 50),
    (11, "", None), (12, "w", ""), (13, "l", LONG), (14, "l", LONG), (None, "m", "alone, without a number " * 9), (None, "m", "alone, without a number " * 9), (-3, "z", "\r\n\r\nWARC/1.1\r\n\r\n" * 40), (15, "n", "\x00\x1f\x8b"),
]


def expected(rows):
    first = {}
    for number, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and number is not None:
            first[body] = min(number, first.get(body, number))
    out = []
    for number, _, html in rows:
        body = (html or "").encode()
        other = first.get(body) if first.get(body) != number else None
        out.append((number, len(body), hashlib.sha256(body).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=repr)


def read(frame):
    rows = frame.select(F.expr("try_cast(substring(record_id, 10) AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.expr("try_cast(substring(refers_to, 10) AS bigint)").alias("refers_to")).collect()
    return sorted(map(tuple, rows), key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "r", "p") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("archive", [1, 5_000, 1 << 26])
def test_odd_rows_come_back(spark, archive):
    done, into = warc.archived(pages(spark, ODD), archive=archive)
    back = warc.read_records(warc.offset_index(done, into), into)
    assert read(back) == expected(ODD)
    assert back.where("NOT intact").count() == 0
    got = {r.payload_digest: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert {hashlib.sha256(p).hexdigest(): p for p in got.values()} == got
    assert "http://a/%20b%0D%0AWARC-Type:%20x" in {r.target_uri for r in back.select("target_uri").collect()}


def test_whole_table_and_offsets(spark):
    """Each line of a sidecar names a whole gzip member, and the members together are the archive."""
    done, into = warc.archived(spark.read.parquet(f"{SF}/pages.parquet"), archive=100_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    index = warc.offset_index(done, into)
    assert read(warc.read_records(index, into)) == expected(rows)
    assert done.where("error IS NOT NULL").count() == 0 and done.count() > 1
    _, folder = warc.place(into)
    for archive, n, size in [(r.archive, r.records, r.bytes) for r in done.collect()]:
        with open(os.path.join(folder, archive), "rb") as f:
            whole = f.read()
        lines = sorted((r.offset, r.length) for r in index.where(F.col("archive") == archive).collect())
        assert [o for o, _ in lines] == [sum(k for _, k in lines[:i]) for i in range(n)] and sum(k for _, k in lines) == size == len(whole)
        assert all(gzip.decompress(whole[o:o + k]).startswith(b"WARC/1.1\r\n") for o, k in lines)


def test_one_record_by_offset(spark):
    done, into = warc.archived(pages(spark, ODD))
    one = warc.offset_index(done, into).where(F.col("record_id") == "urn:page:-3")
    assert [bytes(r.payload).decode() for r in warc.read_records(one, into).collect()] == [ODD[13][2]]


def test_empty_table(spark):
    done, into = warc.archived(pages(spark, []))
    assert warc.read_records(warc.offset_index(done, into), into).collect() == []


def stream(n, whole=True):
    parts = [b"".join([*warc.record(str(i), f"http://h/{i}", b"body %d" % i * 50, len(b"body %d" % i * 50), "d" * 64, None, "2000-01-01T00:00:00Z"), b"\r\n\r\n"]) for i in range(n)]
    return gzip.compress(b"".join(parts)) if whole else b"".join(map(gzip.compress, parts))


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
@pytest.mark.parametrize("whole", [True, False])
def test_streams_of_one_or_many_members(piece, whole):
    out, index = io.BytesIO(), io.BytesIO()
    warc_in = warc.Inflated(io.BytesIO(stream(5, whole)), piece)
    assert [f["warc-record-id"] for _, f, n in warc.records_in(warc_in) if sum(map(len, warc_in.take(n))) == n] == [f"<urn:page:{i}>" for i in range(5)]
    assert len(list(warc.rewritten(io.BytesIO(stream(5, whole)), out, index, "a"))) == 5
    again = io.BytesIO()
    assert len(list(warc.rewritten(io.BytesIO(out.getvalue()), again, io.BytesIO(), "a"))) == 5 and again.getvalue() == out.getvalue()


@pytest.mark.parametrize("damage, said", [(lambda s: s[:len(s) // 2], "ends early"), (lambda s: b"no gzip at all", "not a gzip"), (lambda s: gzip.compress(gzip.decompress(s)[:-3]), "ends early"),
                                          (lambda s: gzip.compress(gzip.decompress(s) + b"rest\r\n\r\n"), "no record"), (lambda s: gzip.compress(gzip.decompress(s).replace(b"Content-Length: 3", b"Content-Length: 1", 1)), "")])
def test_broken_streams_keep_what_came_before(spark, tmp_path, damage, said):
    raw, into = tmp_path / "raw", tmp_path / "into"
    raw.mkdir()
    (raw / "good.warc.gz").write_bytes(stream(3))
    (raw / "bad.warc.gz").write_bytes(damage(stream(20)))
    done = warc.normalise(spark.createDataFrame([("good.warc.gz",), ("bad.warc.gz",)], "archive string"), str(raw), str(into))
    status = {r.source: r for r in done.collect()}
    assert status["good.warc.gz"].error is None and status["good.warc.gz"].records == 3
    assert said in status["bad.warc.gz"].error
    index = warc.offset_index(done, str(into))
    assert index.count() == 3 + status["bad.warc.gz"].records
    assert warc.read_records(index, str(into)).count() == 3 + status["bad.warc.gz"].records
