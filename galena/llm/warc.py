"""WARC archives with a shared Zstandard dictionary, written and read by Spark.

A leading skippable frame of each archive holds the dictionary that was built from that
archive's first records, and every record is a Zstandard frame of its own, compressed
with it.  Spark's text writer puts the bytes out as they are (through its commit protocol,
to whatever store the path names), with an empty skippable frame as the separator, so that
the files are plain Zstandard streams.  A row of the writer holds frames of about
``ROW_BYTES``; after the dictionary and ``ARCHIVE_ROWS`` such rows the next archive begins, so
archives are bounded in size and can be read as one value each.

Records with equal payloads of some size are written once: the one with the
smallest id is the response, the others are revisit records that name it and keep
no payload.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import fresh_path

DICTIONARY_MAGIC = 0x184D2A5D  # fixed value of the .warc.zst format
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")  # an empty skippable frame
SAMPLE_BYTES = 2 << 20  # of records from which an archive's dictionary is built
DICTIONARY_BYTES = 32 << 10
ROW_BYTES, ARCHIVE_ROWS = 4 << 20, 16  # an archive has at most so many rows of about so many bytes (and the rest of its last record)
SALTS = 16  # among which the copies of one payload are dealt


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(id, url, payload, digest, refers_to) of each row; refers_to is null for a response.

    A null payload counts as empty.  Rows repeated with the smallest id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    first = first.where(F.length("payload") >= least_bytes).groupBy(F.sha2("payload", 256).alias("key")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 AND first_id IS NOT NULL")
    # copies of one payload are dealt to several tasks; small payloads, which refer to nothing, go anywhere
    first = first.select("key", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("key", F.when(F.length("payload") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(first, ["key", "salt"], "left")
    refers = F.when((F.length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def _name(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(key.encode()).digest()[:16], version=4)}>"


def _response_name(page: int | None, digest: str) -> str:
    """The record id that revisits know a response by; only rows repeated as a whole share it."""
    return _name(f"response {page} {digest}")


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, own: str) -> bytes:
    """A WARC/1.1 record; ``own`` names a revisit, a response is named by its page and digest.  The X- fields hold page numbers (none: null)."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = _response_name(page, digest) if refers_to is None else _name(f"revisit {page} {digest} {own}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"X-Page: {'none' if page is None else page}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_response_name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], date: str, sample_bytes: int, row_bytes: int, rows: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            for i in range(len(batch)):
                n += 1
                yield _record(*(batch.column(j)[i].as_py() for j in range(5)), date, f"{task.partitionId()} {n}")

    source = records()
    while True:
        sample, size = [], 0
        for record in source:
            sample.append(record)
            size += len(record)
            if size >= sample_bytes:
                break
        if not sample:
            return
        yield from _archive(itertools.chain(sample, source), _dictionary(sample), row_bytes, rows)


def _dictionary(sample: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too few or too small records to train from: their own bytes serve as content
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archive(source: Iterator[bytes], dictionary, row_bytes: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of one archive: its dictionary, then frames of records of ``source``."""
    import zstandard

    def row(*frames: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], ["value"])

    raw = dictionary.as_bytes()
    press = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    yield row(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    for _ in range(rows):
        frames, held = [], 0
        for record in source:
            frames.append(press.compress(record))
            held += len(frames[-1])
            if held >= row_bytes:
                break
        if not frames:
            return
        yield row(*frames)


def write_archives(records: DataFrame, path: str, date: str | None = None) -> None:
    """Write ``plan_records`` rows as .warc.zst streams of bounded size below ``path``; an empty table gives no archive.

    ``date`` is when the payloads were got, as ``2024-01-31T12:00:00Z``; unless given it is now.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    limits = date, SAMPLE_BYTES, ROW_BYTES, ARCHIVE_ROWS
    frames = records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(lambda batches: _write(batches, *limits), "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS + 1).text(path)


def _frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive; memory is the archive and one record."""
    import zstandard

    at, dictionary, view = 0, None, memoryview(data)
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                dictionary = zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size])
            at += 8 + size
            continue
        press = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, end = [], at
        while not press.eof:
            parts.append(press.decompress(view[end : end + 65536]))
            end += 65536
        at = min(end, len(data)) - len(press.unused_data)
        yield b"".join(parts)


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: None if x == "none" else int(x)
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return number(fields["X-Page"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], digest, number(fields["X-Refers-To-Page"]) if revisit else None, None if revisit else payload


_READ = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for record in _frames(content.as_py()):
                rows.append(_parse(record))
                held += len(record)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, digest, refers_to, payload) of each record below ``path``; a revisit's payload is null."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, "id long, url string, record_type string, digest string, refers_to long, payload binary")


def digests(records: DataFrame) -> DataFrame:
    """Full payload size and digest of each record; a revisit's are those of the response that it names and whose digest it bears."""
    slim = records.select("id", "record_type", "refers_to", "digest", F.length("payload").cast("long").alias("payload_bytes"))
    whole = slim.where("record_type = 'response'")
    target = whole.select(F.col("id").alias("refers_to"), "digest", F.col("payload_bytes").alias("full_bytes")).distinct()
    again = slim.where("record_type = 'revisit'").drop("payload_bytes").join(target, ["refers_to", "digest"], "left")
    return whole.select("id", "payload_bytes", "digest", "record_type", "refers_to").unionByName(again.select("id", F.col("full_bytes").alias("payload_bytes"), "digest", "record_type", "refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back.

    Nulls: html null is an empty payload, url null has no target header, page_id null stays null.  Rows repeated with
    the smallest page_id are all responses; a page_id may have several payloads; other columns are not read.
    """
    path = fresh_path(spark, "warc")
    write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    back = digests(read_archives(spark, path))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
