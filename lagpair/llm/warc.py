"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, in one table; exact record
and HTTP headers stand in another. Records are reconstructed by joining the two
on the digest, and every payload is verified against its digest on the way. What
is read back of records alone (:func:`archived`) moves digests and lengths of
payloads, not their bytes.

All but the export to .warc.gz files is DataFrame expressions. A page whose
payload occurs more often is a ``revisit`` of the page with the largest id among
the equal ones; payloads under ``min_revisit_bytes`` are never revisited. A
response's block is an HTTP head and the payload, a revisit's the head alone.

Edge cases: a null html is the empty payload; a null url is written as
``about:blank``; empty tables give empty archives. Rows that repeat a page_id
with one payload are each a record, of one type; their payload is stored once.
A null page_id sorts below all others, a ``refers_to`` of it is null, and its
record has a UUID for an id. Columns of ``pages`` other than page_id, url and html
are ignored.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair.llm.common import remove, small_batches, work_path

# Digits of conv() in base 32, and the base32 alphabet of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
WARC_DATE = "1970-01-01T00:00:00Z"


#: Stands for a null page_id, below all others.
NO_ID = -(2**63)


def _known(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID))


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are four groups of 40, each of eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """A row per page: its id, url, digests, length, record type and the page it refers to; no payload bytes.

    The digests are grouped with partial aggregation, so a payload that a third
    of the pages share is counted before it moves; the join back is one that
    adaptive execution can split by key.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id"),
        F.coalesce("url", F.lit("about:blank")).alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("content_key"),
        base32_sha1(payload).alias("payload_digest"),
    )
    top = keyed.groupBy("content_key").agg(F.max(_known("page_id")).alias("top_id"), F.count(F.lit(1)).alias("copies"))
    joined = keyed.join(top, "content_key")
    alone = (F.col("copies") == 1) | (F.col("payload_bytes") < min_revisit_bytes)
    first = _known("page_id") == F.col("top_id")
    return joined.select(
        "page_id",
        "url",
        "payload_bytes",
        "payload_digest",
        "content_key",
        F.when(alone | first, "response").otherwise("revisit").alias("record_type"),
        F.when(~(alone | first) & (F.col("top_id") != NO_ID), F.col("top_id")).alias("refers_to"),
    )


def with_headers(recs: DataFrame) -> DataFrame:
    """Adds the exact header bytes of each record, and the HTTP head that its block begins with."""
    revisit = F.col("record_type") == "revisit"
    urn = F.coalesce(F.concat(F.lit("page:"), F.col("page_id").cast("string")), F.concat(F.lit("uuid:"), F.uuid()))
    size = F.col("payload_bytes")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html;charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:"), urn, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(WARC_DATE)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit & F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return recs.withColumns({"header": F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary"), "http": http.cast("binary")})


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes ``path``/headers (a row per record) and ``path``/payloads (a row per distinct payload).

    The response with the largest id brings the bytes: pages are joined with the
    owners on digest and id together, a key that no group of copies shares.
    """
    spark = pages.sparkSession
    with_headers(records(pages, min_revisit_bytes)).select("page_id", "record_type", "content_key", "header", "http").write.parquet(f"{path}/headers")
    responses = spark.read.parquet(f"{path}/headers").where("record_type = 'response'")
    owner = responses.groupBy("content_key").agg(F.max(_known("page_id")).alias("owner_id"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    bodies = pages.select(_known("page_id").alias("owner_id"), payload.alias("payload")).withColumn("content_key", F.sha2("payload", 256))
    owned = bodies.join(owner, ["content_key", "owner_id"]).select("content_key", "payload")
    repeats = responses.groupBy("content_key", "page_id").count().where("count > 1").limit(1).count()
    (owned.dropDuplicates(["content_key"]) if repeats else owned).write.parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(content_key, payload) of each distinct payload. Fails on bytes that do not match their digest."""
    damaged = F.raise_error(F.lit("payload does not match its digest"))
    return spark.read.parquet(f"{path}/payloads").select("content_key", F.when(F.sha2("payload", 256) == F.col("content_key"), F.col("payload")).otherwise(damaged).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Reconstructs each record: (header, payload, record bytes). Revisits carry no payload of their own in the record,
    but ``payload`` has the bytes that they refer to."""
    heads = spark.read.parquet(f"{path}/headers").select("content_key", "header", "http", "record_type")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return heads.join(read_payloads(spark, path), "content_key", "left").select(
        "header",
        F.coalesce("payload", F.raise_error(F.lit("payload is missing")).cast("binary")).alias("payload"),
        F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def parse_headers(heads: DataFrame) -> DataFrame:
    """Reads page_id, type, reference, address and digest from header bytes, beside the other columns."""
    head = F.col("header").cast("string")

    def field(name: str, value: str = "[^\r\n]*") -> Column:
        return F.regexp_extract(head, f"(?m)^{name}: ({value})\r?$", 1)

    refers = F.regexp_extract(head, "(?m)^WARC-Refers-To: <urn:page:(-?[0-9]+)>", 1)
    page = F.regexp_extract(head, "(?m)^WARC-Record-ID: <urn:page:(-?[0-9]+)>", 1)
    return heads.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))).alias("digest_ok"),
    )


def archived(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages as an archive, reads it back and parses its records; lengths and digests are those of the payload bytes
    that were read."""
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write_archive(pages, path, min_revisit_bytes)
    sizes = read_payloads(spark, path).select("content_key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    missing = F.raise_error(F.lit("payload is missing"))
    heads = spark.read.parquet(f"{path}/headers").select("content_key", "header").join(sizes, "content_key", "left")
    return parse_headers(heads.withColumn("payload_bytes", F.coalesce("payload_bytes", missing.cast("long"))))


def _exported(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    store, base = pafs.FileSystem.from_uri(folder)
    path, n = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
    with store.open_output_stream(path, compression=None) as out:
        for batch in batches:
            for record in batch.column("record"):
                out.write(gzip.compress(record.as_py(), 6))  # a member for each record, as the format asks for
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes the archive's records as .warc.gz files of ``folder`` (a URI of a shared store); returns (path, n_records) of
    the tasks that succeeded, files of failed ones being no part of it."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/files", recursive=True)
    small_batches(spark)
    target = f"{folder}/files"
    read_records(spark, path).select("record").mapInArrow(lambda b: _exported(b, target), "path string, n_records long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def delete_archive(spark: SparkSession, path: str) -> None:
    remove(spark, path)
