import hashlib

import pytest

from quarry.llm import warc
from quarry.llm._common import scratch


@pytest.fixture()
def pages(spark):
    big, small = "<p>" + "x" * 200 + "é</p>", "<p>short</p>"
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, None, big), (1, "u", small), (3, "u\r\nX: y", small),
            (4, "u", None), (6, "u", ""), (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "z" * 99),
            (11, "u", "z" * 99), (None, "u", big), (12, "u", "w" * 300_000)]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_summary(spark, pages):
    got = sorted(map(tuple, warc.archive_summary(pages, scratch(spark, "w")).collect()), key=str)
    want = []
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    for page_id, body in rows:
        first = min((p for p, b in rows if b == body and p is not None), default=None)
        revisit = len(body) >= 100 and page_id != first
        want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_payloads_once_and_records_whole(spark, pages):
    folder = warc.write_archive(pages, scratch(spark, "w"))
    payloads = spark.read.parquet(f"{folder}/payloads")
    assert payloads.count() == len({(r.html or "") for r in pages.collect()})
    for r in warc.records(spark, folder).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.count(b"WARC-Type") == 1 and rest.endswith(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and b"X" not in fields
        if fields[b"WARC-Type"] == b"response":
            body = rest[:-4].partition(b"\r\n\r\n")[2]
            assert hashlib.sha256(body).hexdigest() == fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
        else:
            assert fields[b"WARC-Profile"] and fields[b"WARC-Refers-To"]


def test_damage_is_found(spark, pages):
    folder = warc.write_archive(pages, scratch(spark, "w"))
    other = scratch(spark, "w")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    from pyspark.sql import functions as F
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, other).select("payload_digest").collect()


def test_nothing(spark, pages):
    assert warc.archive_summary(pages.limit(0), scratch(spark, "w")).count() == 0
