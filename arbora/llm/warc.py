"""Operator 2: WARC archives and the resolution of revisits."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, scratch_path, spread_join, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, uri string, payload_digest string, payload_bytes long, archive string, offset long, length long"
MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long"


def _record(kind: str, page_id, uri, record_id: str, digest: str, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One gzip member. The HTTP block of a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if payload is None else b"Content-Length: %d\r\n" % len(payload)) + b"\r\n"
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in uri))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unzip, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            return
        parts.append(unzip.decompress(data))
        data = b""
        if unzip.eof:
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data, zlib.decompressobj(31), []


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One archive for each task, a response record for each row (page_id, url, html); returns the header table.

    A file has a name of its own for each attempt, so those of lost or repeated tasks are never referred to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, uri, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                record = _record("response", page_id, uri, str(uuid.uuid4()), digest, payload)
                out.write(record)
                rows.append((page_id, uri, digest, len(payload), name, at, len(record)))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES, strict=True)], NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in TYPES], NAMES)
        if out:
            out.close()

    NAMES = [x.split()[0] for x in HEADERS.split(", ")]
    TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in HEADERS.split(", ")]
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(rows.mapInArrow(write, HEADERS), "warc-headers")


def resolve(headers: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Headers with record_type, record_id and refers_to_id.

    Of records with equal payloads of at least least_bytes, the one with the smallest page_id is the response (null ids
    last; among equal ids the first archive place), the others revisit it. The digest groups are reduced before they
    are shuffled, and rows of a hot digest are not brought together to learn its response.
    """
    fresh = F.md5(F.concat_ws("|", "archive", F.col("offset").cast("string")))
    record_id = F.regexp_replace(fresh, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    headers = headers.withColumn("record_id", record_id)
    first = (
        headers.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.count("*").alias("copies"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset", "record_id")).alias("o"))
        .select("payload_digest", "copies", F.col("o.record_id").alias("first"))
    )
    revisit = F.col("first") != F.col("record_id")
    # Only digests that repeat have anything to tell, and hot ones are broadcast.
    return spread_join(headers, stored(first.where("copies > 1"), "warc-first"), "payload_digest", "copies", ["first"]).select(
        *headers.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to_id"),
    )


def write_deduplicated(resolved: DataFrame, source: str, target: str) -> DataFrame:
    """New archives with fresh headers: responses keep their payload, revisits only refer; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, base = filesystem(source)
        new, to = filesystem(target)
        new.create_dir(to, recursive=True)
        name, out, records, at, opened, handle = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                payload = None
                if r["record_type"] == "response":
                    if opened != r["archive"]:
                        handle = old.open_input_file(f"{base}/{r['archive']}")
                        opened = r["archive"]
                    handle.seek(r["offset"])
                    payload = _parse(gzip.decompress(handle.read(r["length"])))[1]
                out = out or new.open_output_stream(f"{to}/{name}", compression=None)
                record = _record(r["record_type"], r["page_id"], r["uri"], r["record_id"], r["payload_digest"], payload, r["refers_to_id"])
                out.write(record)
                records, at = records + 1, at + len(record)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([at])], ["archive", "records", "bytes"])

    return stored(resolved.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record. A response's digest and length are taken from its payload; one that belies its header raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        fields, payload = _parse(record)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                        page = fields.get("page-id")
                        refers = fields.get("warc-refers-to")
                        rows.append((None if page is None else int(page), kind, fields["warc-record-id"][10:-1], refers and refers[10:-1], digest, len(payload) if kind == "response" else None))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names)

    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORDS.split(", ")]
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("archive").repartition(spread, "archive").mapInArrow(read, RECORDS)


def deduplicate(pages: DataFrame, least_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """pages (page_id, url, html) through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payload: html in UTF-8, null as empty. Payloads under least_bytes are always responses. Null page_ids and urls are
    left out of the headers and come back null; repeated rows are records of their own. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    headers = write_archives(pages, f"{folder}/raw")
    # Stored before they are sorted by place, which reads them twice (once for a sample).
    resolved = stored(resolve(headers, least_bytes), "warc-resolved")
    manifest = write_deduplicated(resolved, f"{folder}/raw", f"{folder}/deduplicated")
    records = stored(read_archives(manifest, f"{folder}/deduplicated"), "warc-records")  # the archives are read once
    revisits = records.where("record_type = 'revisit'").groupBy("refers_to_id").agg(F.count("*").alias("copies"))
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    originals = stored(revisits.join(originals.hint("merge"), "refers_to_id"), "warc-originals")
    return spread_join(records, originals, "refers_to_id", "copies", ["refers_to", "bytes"]).select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


__all__ = ["deduplicate", "read_archives", "resolve", "write_archives", "write_deduplicated"]
