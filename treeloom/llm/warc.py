"""WARC archives: a writer, and a reader that salvages what damage leaves.

Writing: each record is one gzip member, as the format asks, so a damaged member costs one record.
Spark's text writer commits the files: a value is the bytes of a member, and the line separator is an
empty gzip member, which decompresses to nothing. So files land in any store that Spark can write.

Reading: files come as rows (path, content). A member is kept if it decompresses whole, its version line
and headers parse, the length fits, and the digest of the block agrees. After a failed check the reader
looks for the next member that passes (or, in plain archives, the next version line whose record passes),
goes on there, and logs the gap in between: path, first byte, length and reason.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import settle
from treeloom.session import stage_root

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
BETWEEN = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "page")
RECORD = "path string, offset long, length long, problem string, record_id string, record_type string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, kind: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """The bytes of one record. A revisit has no payload of its own but names its digest and length."""
    body = b"" if kind == "revisit" else payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(body)}"),
        ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    # A line break inside a value would end the header, so it is written as a space.
    head = b"".join(f"{k}: {' '.join(v.split())}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError if a check fails."""
    if data[at : at + 7] != b"WARC/1.":
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no length") from None
    begin = head_end + 4
    block, end = data[begin : begin + size], begin + size + 4
    if size < 0 or len(block) != size or data[begin + size : end] != b"\r\n\r\n":
        raise ValueError("length does not fit")
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named[5:] != digest(block):
        raise ValueError("digest differs")
    return headers, block, end


def _inflate(data: memoryview) -> tuple[bytes, int]:
    """One whole member: its content and its length."""
    unpacker = zlib.decompressobj(31)
    try:
        out = unpacker.decompress(data) + unpacker.flush()
    except zlib.error as e:
        raise ValueError("broken member") from e
    if not unpacker.eof:
        raise ValueError("member does not end")
    return out, len(data) - len(unpacker.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, problem, headers, block) for each record and each quarantined gap of an archive.

    Works on gzip members and on plain records, also mixed. A gap runs from a failed check to the next
    place where a whole record passes, or to the end. A member may hold several records.
    """
    at, gap, reason = 0, None, ""
    view = memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                # Members are small beside an archive: offer ever longer pieces until one ends.
                reach = 1 << 16
                while True:
                    try:
                        inner, size = _inflate(view[at : at + reach])
                        break
                    except ValueError as e:
                        if str(e) != "member does not end" or at + reach >= len(data):
                            raise
                        reach *= 4
                found, inside = [], 0
                while inside < len(inner):
                    headers, block, inside = parse(inner, inside)
                    found.append((headers, block))
            else:
                headers, block, end = parse(data, at)
                found, size = [(headers, block)], end - at
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            marks = [x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(marks, default=len(data))
            continue
        if gap is not None and found:
            yield gap, at - gap, reason, {}, b""
            gap = None
        for headers, block in found:
            yield at, size, None, headers, block
        at += size
    if gap is not None:
        yield gap, len(data) - gap, reason, {}, b""


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_archives(files: DataFrame) -> DataFrame:
    """Records and quarantined gaps (those with ``problem``) of archives given as rows (path, content).

    ``payload_bytes`` and ``payload_digest`` are of the full payload, also for revisits. A null or empty
    content has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.large_binary()}
        schema = pa.schema([(n, pa.binary() if k == "binary" else kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for offset, length, problem, headers, block in salvage(content.as_py() or b""):
                    named = headers.get("warc-payload-digest", "")
                    size = headers.get("warc-payload-length", "")
                    if problem is None and not named:
                        named = "sha1:" + digest(block)
                    rows.append((
                        path, offset, length, problem, _bare(headers.get("warc-record-id")), headers.get("warc-type"), _bare(headers.get("warc-refers-to")),
                        headers.get("warc-target-uri"), int(size) if size.isdigit() else len(block), named.removeprefix("sha1:") or None, block,
                    ))
                    held += len(block)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, RECORD)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to: which pages revisit a page of equal payload.

    Of pages whose payloads are equal and have at least ``least_bytes`` bytes, the largest page_id is the
    response; smaller payloads are all responses. A null html is an empty payload. Rows that repeat the
    largest page_id are all responses, as no record revisits its own id; a null page_id revisits any other.
    Only digests are grouped; the join that follows is over narrow rows and page_id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("_digest", F.sha2("html", 256))
    last = keyed.filter(F.octet_length("html") >= least_bytes).groupBy("_digest").agg(F.max("page_id").alias("_last"))
    follows = F.col("_last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")))
    return keyed.join(last, "_digest", "left").select(
        "page_id", "url", "html",
        F.when(follows, "revisit").otherwise("response").alias("record_type"),
        F.when(follows, F.col("_last")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str) -> None:
    """Write one record per row of ``plan_records`` below ``folder``, one archive per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = [
                    member(record(page_urn(r["page_id"]), r["record_type"], r["url"] or "", r["html"].encode("utf-8", "surrogatepass"), page_urn(r["refers_to"]) if r["record_type"] == "revisit" else None))
                    for r in batch.slice(start, 64).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    packed = records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "member binary")
    writer = packed.select(F.col("member").cast("string").alias("value")).write.mode("overwrite")
    writer.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


def page_urn(page_id: int | None) -> str:
    """Record id of a page; null has one of its own."""
    return f"urn:page:{'' if page_id is None else page_id}"


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives below a folder as rows (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read the archives back, and return their records."""
    spark = pages.sparkSession
    folder = f"{stage_root(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(plan_records(pages, least_bytes), folder)
    return read_archives(archive_files(spark, folder))
