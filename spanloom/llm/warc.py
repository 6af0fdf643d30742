"""A content-addressed WARC archive.

``write`` makes a WARC record of each capture and stores it as two tables: ``payloads`` holds
the bytes of each different payload once, compressed, under its SHA-256; ``headers`` holds the
exact header bytes of every record and the digest its payload has. ``read`` joins them back to
the captures and checks every payload against its digest; ``records`` gives the exact bytes of
each record as a WARC file holds them, and ``export`` writes WARC files that any reader takes.

Of captures with equal payloads of at least ``revisit_bytes``, the one with the largest id is
the response and the others are revisits that refer to it; smaller payloads are all responses.

Payloads are compressed before they move. Copies of a payload meet in a partial aggregate in
each task first, so a payload that a third of all captures share moves once per task. Headers
are joined by digest, with hot digests split by adaptive execution.

Defined cases: a null payload is empty; a null url is an empty target; a null id is smaller
than all others and repeated ids are captures of their own; an empty table gives two empty
tables. A payload that does not match its digest raises when read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder
from .common import by_rows, tuned

DATE = "2024-01-01T00:00:00Z"
REVISIT_BYTES = 1000


def record_uri(id_: Column) -> Column:
    """An id of a record, from the capture's id; captures that repeat an id share it."""
    return F.concat(F.lit("<urn:capture:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def clean(text: Column) -> Column:
    """Header values hold no line ends."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\r\\n]+", " ")


def header(date: str) -> Column:
    """The exact header block of a record, up to and with its blank line."""
    revisit = F.col("is_revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block_size = F.length(http) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("size"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_uri(F.col("owner")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_size.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http).cast("binary")


def compressed(batch: pa.RecordBatch) -> list:
    return [*(batch.column(i) for i in range(4)), [zlib.compress(p, 6) for p in batch.column(4).to_pylist()]]


PACKED = {"id": pa.int64(), "sha256": pa.binary(), "sha1": pa.string(), "size": pa.int64(), "packed": pa.binary()}
PACKED_DDL = "id bigint, sha256 binary, sha1 string, size bigint, packed binary"


def write(captures: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Write ``captures`` as an archive under ``folder``: tables ``payloads`` and ``headers``."""
    spark = tuned(captures.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = captures.select(
        F.col(id_col).cast("long").alias("id"), clean(F.col(url_col)).alias("url"), F.unhex(F.sha2(payload, 256)).alias("sha256"),
        F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"), payload.alias("payload"),
    )
    packed = rows.select("id", "sha256", "sha1", "size", "payload").mapInArrow(by_rows(PACKED, compressed), PACKED_DDL)
    # Length and SHA-1 are a second view of the bytes: different payloads under one digest would show.
    same = (F.col("low") == F.col("high")) & (F.col("least") == F.col("size"))
    packed.groupBy("sha256").agg(
        F.max("id").alias("owner"), F.max("size").alias("size"), F.min("size").alias("least"),
        F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.first("packed").alias("packed"),
    ).where(F.assert_true(same, F.lit("different payloads share a digest")).isNull()).select("sha256", "owner", "size", "packed").write.parquet(f"{folder}/payloads")

    owners = spark.read.parquet(f"{folder}/payloads").select(F.col("sha256").alias("its"), "owner")
    joined = rows.drop("payload").join(owners, F.col("sha256") == F.col("its"))
    # Captures repeated with the owner's id are all responses.
    is_revisit = (F.col("size") >= revisit_bytes) & ~F.col("id").eqNullSafe(F.col("owner"))
    joined.withColumn("is_revisit", is_revisit).select("id", "sha256", header(date).alias("header")).write.parquet(f"{folder}/headers")


def unpacked(batch: pa.RecordBatch) -> list:
    payloads = []
    for digest, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        payloads.append(zlib.decompress(data))
        if hashlib.sha256(payloads[-1]).digest() != digest:
            raise ValueError(f"stored payload does not match its digest {digest.hex()}")
    return [batch.column(0), batch.column(1), payloads]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """id, header, payload: every capture with the full payload it had, checked against its digest."""
    tuned(spark)
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    joined = headers.join(payloads.select(F.col("sha256").alias("its"), "packed"), F.col("sha256") == F.col("its"))
    fields = {"id": pa.int64(), "header": pa.binary(), "payload": pa.binary()}
    return joined.select("id", "header", "sha256", "packed").mapInArrow(by_rows(fields, unpacked), "id bigint, header binary, payload binary")


def field(name: str) -> Column:
    """A WARC header field of ``header``; empty when absent."""
    return F.regexp_extract(F.col("header").cast("string"), f"(?s)^WARC/1\\.1\r\n(?:.*?\r\n)??{name}: ([^\r\n]*)\r\n", 1)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """id, record: the exact bytes of each record as a WARC file holds them."""
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return read(spark, folder).select("id", F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def export(spark: SparkSession, folder: str, to: str, records_per_file: int = 10_000) -> None:
    """Write the archive as plain WARC files that any reader takes."""
    record = F.col("record")
    # The text writer ends each value with a line feed: the last byte of every record.
    lines = records(spark, folder).select(F.substring(record, F.lit(1), F.octet_length(record) - 1).cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", records_per_file).text(to)


def parse(data: bytes):
    """(header block, payload) of each record of a WARC file; lengths decide, not separators."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        size = next(int(line[15:]) for line in data[at:end].split(b"\r\n") if line.lower().startswith(b"content-length:"))
        block = data[end : end + size]
        split = block.index(b"\r\n\r\n") + 4
        yield data[at:end] + block[:split], block[split:]
        at = end + size + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """header, body of each record in the WARC files under ``path``; a file must fit a task."""

    def work(batches):
        schema = pa.schema([("header", pa.binary()), ("body", pa.binary())])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(parse(data))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], schema=schema)

    tuned(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "header binary, body binary")


def new_folder(spark: SparkSession) -> str:
    return work_folder(spark, "warc")
