"""WARC archives: write captures, read records, and assemble transactions by their concurrent-to identifiers.

A capture is three records: the response (or a revisit of an equal payload), the request and the metadata,
the last two naming the first in WARC-Concurrent-To. Files are written by Spark's text sink (a record is a
string whose end is the sink's line end), so any store that Spark writes will do; they are read as binary
files and cut by Content-Length, never by what a payload might contain.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm.common import materialize, ready

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Bounds a file, and so what a reading task holds.
RECORDS_PER_FILE = 6000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
HEADERS = ("WARC-Record-ID", "WARC-Type", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest")
RECORD = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
          "payload_digest string, http_header string, payload binary, payload_bytes long, payload_sha256 string")


def _identifier(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, identifier: Column, block: Column, content_type: str, uri: Column, date: str, *more: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    # the sink's line end is the last of the four bytes that end a record
    return F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", identifier), line("WARC-Date", F.lit(date)),
                    line("WARC-Target-URI", uri), *more, line("Content-Type", F.lit(content_type)),
                    line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r"))


def write_captures(pages: DataFrame, path: str, date: str = EPOCH) -> None:
    """Write the three records of each row of ``pages`` (page_id, url, html) under ``path``.

    A null html is an empty payload, a null url an empty one; line ends in a url are percent-encoded. Of
    equal payloads of REVISIT_BYTES or more, the smallest page_id is the response and the others revisit
    it (rows that share that page_id are all responses; without any page_id all are). Repeated rows repeat
    their records under one identifier. An empty table writes no record.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    firsts = (rows.where(f"n >= {REVISIT_BYTES} AND page_id IS NOT NULL").groupBy(F.col("digest").alias("d"))
              .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    # written first: the join then shuffles two plain inputs, and AQE can split the pages that share one payload
    firsts, _ = materialize(firsts, "firsts")
    rows = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("n") >= REVISIT_BYTES), "left")
    again = F.coalesce(~F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(), F.lit(False))
    rows = rows.withColumn("again", again)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    own = _identifier("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"))
    origin = F.concat(F.lit("WARC-Refers-To: "), _identifier("capture", F.col("first.page_id"), F.col("first.url"), F.col("digest")),
                      F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    response = _record(F.when(F.col("again"), "revisit").otherwise("response"), own,
                       F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html"))), "application/http;msgtype=response", uri, date,
                       digest, F.when(F.col("again"), origin).otherwise(""))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), own, F.lit("\r\n"))
    request = _record("request", _identifier("request", F.col("page_id"), F.col("url"), F.col("digest")),
                      F.concat(F.lit("GET / HTTP/1.1\r\n\r\n")), "application/http;msgtype=request", uri, date, beside)
    metadata = _record("metadata", _identifier("metadata", F.col("page_id"), F.col("url"), F.col("digest")),
                       F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
                       "application/warc-fields", uri, date, beside)
    (rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .option("compression", "gzip").text(path))


def archive(content: bytes | None) -> bytes:
    """A file's records: gzip in any number of members, or plain."""
    content = content or b""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse(whole: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The records of an uncompressed archive: header fields by lower-case name, and the block."""
    at, data = 0, memoryview(whole)
    while True:
        at = whole.find(b"WARC/1.", at)
        if at < 0:
            return
        end = whole.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"no end of the header that starts at byte {at}")
        fields = {}
        for line in whole[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        at = start + int(fields.get("content-length", 0))
        if at > len(whole):
            raise ValueError("a record is cut off")
        yield fields, data[start:at]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]] for x in RECORD.split(", ")]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for cell in batch.column(0):
            rows, held = [], 0
            for fields, block in parse(archive(cell.as_py())):
                head, payload = "", bytes(block)
                if fields.get("content-type", "").startswith("application/http"):
                    top, _, payload = payload.partition(b"\r\n\r\n")
                    head = top.decode("utf-8", "replace")
                rows.append((*(fields.get(h.lower()) for h in HEADERS), head, payload, len(payload), hashlib.sha256(payload).hexdigest()))
                held += len(payload)
                if len(rows) >= 2000 or held > 1 << 24:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``: RECORD's columns; payload without the HTTP header."""
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_records, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: capture_id, record_type, target_uri, response, request, metadata, origin.

    Requests and metadata join the record that they name in WARC-Concurrent-To (of several, the one with the
    largest identifier), and a revisit's ``origin`` is the metadata of the record that it refers to. Partners
    that are missing leave nulls; requests and metadata that name no record are left out.
    """
    part = lambda kind, *cols: (records.where(F.col("record_type") == kind).where("concurrent_to IS NOT NULL")
                                .groupBy(F.col("concurrent_to").alias("capture_id"))
                                .agg(F.max(F.struct("record_id", *cols)).alias(kind)))
    main = records.where("record_type IN ('response', 'revisit')").select(
        F.col("record_id").alias("capture_id"), "record_type", "target_uri", "refers_to",
        F.struct("warc_date", "payload_digest", "http_header", "payload", "payload_bytes", "payload_sha256").alias("response"))
    # written: small rows, read twice, and the joins below then shuffle plain inputs, which AQE splits at a hot origin
    metadata, _ = materialize(part("metadata", F.col("payload").cast("string").alias("fields")), "metadata")
    request = part("request", "http_header")
    whole = main.join(request, "capture_id", "left").join(metadata, "capture_id", "left")
    origin = metadata.select(F.col("capture_id").alias("refers_to"), F.col("metadata").alias("origin"))
    out = ["capture_id", "record_type", "target_uri", "refers_to", "response", "request", "metadata", "origin"]
    # only what refers to a record is dealt out by that record
    refers = whole.where("refers_to IS NOT NULL").join(origin, "refers_to", "left").select(*out)
    return refers.union(whole.where("refers_to IS NULL").withColumn("origin", F.lit(None).cast(refers.schema["origin"].dataType)).select(*out))


def field(metadata: Column, name: str) -> Column:
    """A field of a metadata record; null where it is missing or empty."""
    value = F.regexp_extract(metadata.getField("fields"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)
