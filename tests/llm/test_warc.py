"""The archive gives back what went in."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tideloom.llm.warc import PROFILE, parsed, read_archive, records, write_archive


def pages(spark):
    long_ = "<p>é</p>" * 30
    rows = [(3, "http://a/", long_), (1, "http://b/\r\nX: y", long_), (2, None, long_), (4, "", "short"), (5, "u%0A", "short"), (6, "u", None), (7, "u", ""), (None, "n", long_), (1, "http://b/\r\nX: y", long_), (9, "v", "q" * 100_000)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest string")


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    write_archive(df, str(tmp_path / "a"))
    got = read_archive(spark, str(tmp_path / "a")).collect()
    key = lambda r: str(r)
    assert sorted(((None if x["page_id"] is None else int(x["page_id"]), x["url"], bytes(x["payload"]).decode()) for x in got), key=key) == sorted(((i, u, h or "") for i, u, h in rows), key=key)
    for x in got:
        assert x["payload_digest"] == hashlib.sha256(bytes(x["payload"])).hexdigest() and x["payload_bytes"] == len(x["payload"])
        again = len(x["payload"]) == 270 and x["page_id"] != "1"
        assert (x["record_type"], x["refers_to"]) == (("revisit", "1") if again else ("response", None))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4


def test_a_file_of_records_is_read_record_by_record(spark, tmp_path):
    rows, df = pages(spark)
    write_archive(df, str(tmp_path / "b"))
    made = records(read_archive(spark, str(tmp_path / "b")))
    file = b"".join(bytes(x["record"]) for x in made.collect())
    found = []
    while file:
        head, _, rest = file.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        fields = dict(h.split(b": ", 1) for h in lines)
        size = int(fields[b"Content-Length"])
        block, end, file = rest[:size], rest[size : size + 4], rest[size + 4 :]
        assert version == b"WARC/1.1" and end == b"\r\n\r\n" and len(block) == size
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields[b"Content-Type"] == b"application/http; msgtype=response"
        again = fields[b"WARC-Type"] == b"revisit"
        assert (fields.get(b"WARC-Profile") == PROFILE.encode()) == again and (not again or payload == b"")
        assert again or fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
        found.append((fields.get(b"WARC-Page-ID"), again))
    assert len(found) == len(rows) and sum(again for _, again in found) == 3
    for x in parsed(made).collect():
        assert x["payload_bytes"] in (0, 5, 270, 100_000) and (x["record_type"] == "revisit") == (x["refers_to"] == "1")
    with pytest.raises(Exception, match="broken record"):
        parsed(made.withColumn("record", F.expr("substring(record, 1, length(record) - 5)"))).collect()


def test_damage_is_noticed(spark, tmp_path):
    _, df = pages(spark)
    write_archive(df, str(tmp_path / "c"))
    p = spark.read.parquet(str(tmp_path / "c/payloads"))
    p.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(str(tmp_path / "d/payloads"))
    spark.read.parquet(str(tmp_path / "c/headers")).write.parquet(str(tmp_path / "d/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, str(tmp_path / "d")).collect()


def test_empty(spark, tmp_path):
    _, df = pages(spark)
    write_archive(df.limit(0), str(tmp_path / "e"))
    assert read_archive(spark, str(tmp_path / "e")).count() == 0
