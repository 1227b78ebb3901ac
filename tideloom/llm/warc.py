"""A content-addressed archive of web records.

``write_archive`` makes two tables under a folder: ``payloads`` holds the bytes
of each distinct payload once, under their SHA-256, and ``headers`` holds the
exact header block of every record and the HTTP header its block begins with.
``read_archive`` checks every stored payload against its digest and joins it to
the headers again, ``records`` puts the bytes of each record together and
``parsed`` reads them as any reader would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal payloads below this many bytes each keep a response record.
LEAST = 100
#: What a revisit record states about itself.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null. Line breaks and
    percent signs of a value are escaped, so a header can't be split."""
    safe = F.replace(F.replace(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _value(name: str, header: str = "header") -> Column:
    """The value of a header line; null where there is none."""
    got = F.when(F.contains(header, F.lit(f"\n{name}: ")), F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1))
    return F.replace(F.replace(F.replace(got, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))


def _record_id(page: Column, digest: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest, url))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, at, n)]], F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` to the archive at ``path``.

    The payload is the text in UTF-8; null is empty. Of equal payloads of at
    least ``LEAST`` bytes those with the smallest id are response records and
    the rest revisit it; a null id sorts last. Shorter payloads are all
    response records. Repeated rows give repeated records. A null url leaves
    its header line out; other columns aren't read. The block of a response is
    an HTTP header and the payload, that of a revisit the HTTP header only.
    """
    raw = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digested = raw.withColumn("digest", F.sha2("payload", 256))
    digested.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")

    records = digested.select("page", "url", "digest", F.octet_length("payload").cast("bigint").alias("bytes"))
    first = records.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min(F.struct(F.col("page").isNull().alias("last"), "page", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = records.join(first, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first.page")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page"), F.col("digest"), F.col("url"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Page-ID", F.col("page")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(F.col("again"), _record_id(F.col("first.page"), F.col("digest"), F.col("first.url")))),
        _field("WARC-Refers-To-Page", F.when(F.col("again"), F.col("first.page"))),
        _field("WARC-Profile", F.when(F.col("again"), PROFILE)),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _field("Content-Length", F.col("bytes")), F.lit("\r\n"))
    told.withColumn("http", http).select("digest", header.alias("header"), "http").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, page_id, url, refers_to, header, http, payload, payload_bytes,
    payload_digest) of every record, both figures taken from the stored bytes.
    Fails if a stored payload doesn't have the digest it is kept under, or a
    header states another length."""
    stored = spark.read.parquet(f"{path}/payloads").withColumn("actual", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    sound = F.when(F.col("actual") == F.col("digest"), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("archive: damaged payload "), "digest")))
    stored = stored.select("digest", sound.alias("payload_digest"), "payload_bytes", "payload")
    headers = spark.read.parquet(f"{path}/headers")
    out = headers.join(stored, "digest", "left")
    length = F.when(_value("Content-Length", "http").cast("bigint") == F.col("payload_bytes"), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("archive: missing or wrong payload for "), "header")))
    return out.select(
        _value("WARC-Type").alias("record_type"), _value("WARC-Page-ID").alias("page_id"), _value("WARC-Target-URI").alias("url"),
        _value("WARC-Refers-To-Page").alias("refers_to"), "header", "http", "payload", length.alias("payload_bytes"), "payload_digest",
    )


def records(archive: DataFrame) -> DataFrame:
    """The exact bytes of each record of ``read_archive``: header, block and the
    blank lines that end it; beside them what the archive has stored for it."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return archive.select("page_id", record.alias("record"), "payload_bytes", "payload_digest")


def parsed(rows: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the
    bytes in ``record`` say. A response's figures are those of the payload in
    its block; a revisit's are the ones stored, checked against what it states.
    Fails where a record's length isn't its block's or the digests differ."""
    text = rows.withColumn("_text", F.col("record").cast("string")).withColumn("_cut", F.instr("_text", "\r\n\r\n"))
    text = text.withColumn("_head", F.expr("left(_text, _cut + 1)")).withColumn("_block", F.expr("substring(_text, _cut + 4, length(_text) - _cut - 7)"))
    text = text.withColumn("_body", F.expr("substring(_block, instr(_block, '\\r\\n\\r\\n') + 4)"))
    kind = _value("WARC-Type", "_head")
    size = F.when(kind == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("_body").cast("bigint"))
    digest = F.when(kind == "revisit", F.col("payload_digest")).otherwise(F.sha2(F.col("_body").cast("binary"), 256))
    whole = (_value("Content-Length", "_head").cast("bigint") == F.octet_length("_block")) & F.endswith("_text", F.lit("\r\n\r\n"))
    same = _value("WARC-Payload-Digest", "_head") == F.concat(F.lit("sha256:"), digest)
    sound = F.when(whole & same, digest).otherwise(F.raise_error(F.concat(F.lit("archive: broken record "), "_head")))
    return text.select(_value("WARC-Page-ID", "_head").alias("page_id"), size.alias("payload_bytes"), sound.alias("payload_digest"), kind.alias("record_type"), _value("WARC-Refers-To-Page", "_head").alias("refers_to"))
