"""WARC archives: writing with segmentation and chunked transfer framing, and reassembly on reading.

Records are written as plain WARC/1.1 through Spark's text writer (compressed by its codec), so archives
go to any file system that Spark reaches. A payload is framed as HTTP chunks; a record larger than
``segment_bytes`` is cut into a first segment and continuation records. Reading parses whole archive
files of bounded size; segments are then grouped by origin identifier, put in order by segment number,
checked against the announced total length, and the chunked framing is decoded.

Defined results: a null payload is empty. A null key is written without its header and read back as null.
Of rows with equal payloads the smallest key is the response, the others revisit it; rows that repeat
that smallest key are responses too. Of payloads without any key all are responses. An empty table gives
an archive without records. Only the key, address and payload columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrain.storage import StoredTable, checkpoint_root

# Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = b"\r\n"
_KEY_HEADER = "X-Source-Key"

#: Rows with payloads of at least this many bytes can be revisits.
REVISIT_BYTES = 0
#: Records longer than this are cut into segments, and payloads into chunks of this size.
SEGMENT_BYTES = 1 << 10
CHUNK_BYTES = 1 << 9
#: Digests of repeated payloads that are sent to all tasks; for more of them the rows are shuffled by digest.
BROADCAST_DIGESTS = 500_000
#: Bounds the size of an archive file, as a file is parsed by one task.
RECORDS_PER_FILE = 2_000
#: Parsed rows handed on at once.
ROWS_PER_BATCH = 256

SEGMENTS = (
    "kind string, record_id string, origin_id string, segment int, total long, key long, payload_digest string, "
    "refers_to long, announced long, block binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = []
    for start in range(0, len(payload), size):
        part = payload[start : start + size]
        parts += [b"%x" % len(part), _EOL, part, _EOL]
    return b"".join([*parts, b"0", _EOL, _EOL])


def dechunked(framed: bytes) -> bytes:
    """Undoes chunked framing; chunk extensions and trailers are skipped. Raises on a cut body."""
    parts, at = [], 0
    while True:
        end = framed.index(_EOL, at)
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size + 2 > len(framed) or framed[at + size : at + size + 2] != _EOL:
            raise ValueError("chunk is cut")
        parts.append(framed[at : at + size])
        at += size + 2


def _headers(block: bytes, first_line: bool) -> tuple[dict[str, str], int]:
    """Lower-cased header names with values, and where the block after them starts."""
    end = block.find(_EOL + _EOL)
    if end < 0:
        raise ValueError("header without end")
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1 if first_line else 0 :]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, end + 4


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    headers, start = _headers(block, True)
    body = block[start:]
    return dechunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its last line feed, which the text writer adds."""
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    lines.append(b"Content-Length: %d" % len(block))
    return _EOL.join([*lines, b"", block, b"", b""])[:-1]


def _records(key, url, payload: bytes, first, segment_bytes: int) -> Iterator[bytes]:
    """The record of one row, as several segments if its block is long."""
    # Drawn for the row, as rows may repeat. All segments of a row come from this call, so they agree on it.
    name = f"<urn:uuid:{uuid.uuid4()}>"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    common = [
        ("WARC-Target-URI", target),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        (_KEY_HEADER, key),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None and first != key:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common]
        fields += [("WARC-Profile", IDENTICAL_PAYLOAD), ("WARC-Refers-To", f"<urn:key:{first}>")]
        yield _record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    cuts = list(range(0, len(block), segment_bytes))
    yield _record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, start in enumerate(cuts[1:], 2):
        yield _record(
            [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number}')}>"),
                ("WARC-Segment-Origin-ID", name),
                ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", len(block) if number == len(cuts) else None),
            ],
            block[start : start + segment_bytes],
        )


def write_archives(
    pages: DataFrame,
    path: str,
    key: Column,
    url: Column,
    payload: Column,
    revisit_bytes: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Writes one record per row under ``path``.

    Equal payloads are found by digest and length with map-side combining. Only digests that occur more
    than once are joined back: payloads stay where they are read as long as these digests fit into a broadcast, and
    beyond that adaptive execution splits a digest that a large part of the rows share.
    """
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        key.cast("long").alias("key"), url.cast("string").alias("url"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest")
    )
    repeated = (
        rows.where(F.octet_length("body") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    found = StoredTable(repeated, "warc-repeated")
    firsts = F.broadcast(found.df) if found.df.count() <= BROADCAST_DIGESTS else found.df

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS_PER_BATCH):
                out = []
                for row in batch.slice(start, ROWS_PER_BATCH).to_pylist():
                    out += _records(row["key"], row["url"], row["body"], row["first"], segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (
        rows.join(firsts, "digest", "left")
        .select("key", "url", "body", "first")
        .mapInArrow(records, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )
    found.drop()


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive file, plain or gzipped (as a whole or record by record)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == _EOL:
            at += 2
            continue
        end = data.find(_EOL + _EOL, at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields, _ = _headers(data[at : end + 4], True)
        length = int(fields["content-length"])
        if end + 4 + length > len(data):
            raise ValueError("archive is cut")
        yield {"fields": fields, "block": bytes(view[end + 4 : end + 4 + length])}
        at = end + 4 + length


def _parsed(record: dict) -> dict:
    fields, block = record["fields"], record["block"]
    kind = fields["warc-type"]
    number = fields.get("warc-segment-number")
    key, refers_to = fields.get(_KEY_HEADER.lower()), fields.get("warc-refers-to")
    announced = None
    if kind == "revisit":
        announced = int(_headers(block, True)[0]["content-length"])
        block = None
    return {
        "kind": kind,
        "record_id": fields["warc-record-id"],
        "origin_id": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
        "segment": int(number) if number else None,
        "total": int(t) if (t := fields.get("warc-segment-total-length")) else None,
        "key": int(key) if key else None,
        "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to": int(refers_to.strip("<>").rpartition(":")[2]) if refers_to else None,
        "announced": announced,
        "block": block,
    }


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, continuation records by themselves."""
    schema = pa.schema(
        [(n, pa.string()) for n in ("kind", "record_id", "origin_id")]
        + [("segment", pa.int32()), ("total", pa.int64()), ("key", pa.int64()), ("payload_digest", pa.string())]
        + [("refers_to", pa.int64()), ("announced", pa.int64()), ("block", pa.binary())]
    )

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse_archive(content.as_py()):
                    rows.append(_parsed(record))
                    held += len(record["block"])
                    if len(rows) >= ROWS_PER_BATCH or held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, SEGMENTS)


READ = "key long, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary, error string"


def _decode(records: DataFrame) -> DataFrame:
    """Payloads of whole records, given by their blocks in order; what does not decode or match its digest is named in ``error``."""
    schema = pa.schema(
        [("key", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
    )

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS_PER_BATCH):
                rows = []
                for row in batch.slice(start, ROWS_PER_BATCH).to_pylist():
                    payload, error, size = None, row["error"], row["announced"]
                    if row["kind"] == "response" and error is None:
                        try:
                            payload = http_payload(b"".join(row["blocks"]))
                            size = len(payload)
                            if payload_digest(payload) != row["payload_digest"]:
                                error = "digest differs"
                        except ValueError as problem:
                            error = str(problem)
                    rows.append(
                        {
                            "key": row["key"],
                            "record_type": row["kind"],
                            "payload_digest": row["payload_digest"],
                            "refers_to": row["refers_to"],
                            "payload_bytes": size,
                            "payload": payload,
                            "error": error,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return records.mapInArrow(decode, READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole records (``READ``). Revisits have the size and digest of the payload they stand for."""
    segments = read_segments(spark, path)
    columns = ["kind", "key", "payload_digest", "refers_to", "announced", "blocks", "error"]
    whole = segments.where("segment is null and kind in ('response', 'revisit')").withColumn("error", F.lit(None).cast("string"))
    # A group holds the segments of one record, so its size is that of one payload.
    ordered = F.sort_array(F.collect_list(F.struct("segment", "block")))
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "key", "payload_digest", "refers_to", "announced")]
    joined = (
        segments.where("segment is not null")
        .groupBy("origin_id")
        .agg(*first, ordered.alias("parts"), F.max("total").alias("total"))
        .withColumn("length", F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.octet_length(p["block"])))
        .withColumn(
            "error",
            F.when(F.col("total").isNull() | (F.col("length") != F.col("total")), F.lit("total length differs"))
            .when(F.col("kind").isNull(), F.lit("first segment is missing"))
            .when(F.element_at("parts", -1)["segment"] != F.size("parts"), F.lit("segments repeat or are missing")),
        )
    )
    alone = whole.withColumn("blocks", F.array("block"))
    return _decode(alone.select(columns).unionByName(joined.withColumn("blocks", F.col("parts")["block"]).select(columns)))


def archive_round_trip(
    pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options
) -> DataFrame:
    """Writes all rows to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, F.col(key_col), F.col(url_col), F.col(payload_col), **options)
    return read_archives(spark, path)
