"""WARC archives: writing segmented records, and putting them together again.

The writer turns each page into a response record (an HTTP message in chunked
transfer framing, cut into a first segment and continuation records) or into a
revisit record that refers to the response with the same payload. The reader
parses archive files, groups continuations by origin identifier, orders them by
segment number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, _conf, work_dir

REVISIT_FROM = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 4096
CRLF = b"\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = body.find(CRLF, at)
        if eol < 0:
            raise ValueError("chunked body ends within a size line")
        size = int(body[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the two line ends after it."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + END + block


DATE = "2024-01-01T00:00:00Z"


def uri(url: str | None) -> str:
    return (url or "").replace("\r", "").replace("\n", "")


def page_records(key: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, refers_url: str | None = None) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response in segments.

    A revisit names the URI and date of the response, and its page in a header of our own.
    """
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    base = [("WARC-Date", DATE), ("WARC-Target-URI", uri(url)), ("WARC-Payload-Digest", digest), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{key}>"), *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", uri(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to)), ("Content-Type", "application/http; msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{key}>"), *base, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [record(head, block)]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([*head, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{n}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, piece))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write (page_id, url, payload binary, refers_to, refers_url) rows as archives in ``path``.

    Records go out as they are through Spark's text writer, with the two line
    ends that close a record as its line separator, so any store that Spark
    writes will do. Files are gzipped and hold at most
    ``file_records`` records. Rows that
    repeat a page_id become records of their own. Null payloads are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[bytes] = []
            for page_id, url, payload, ref, ref_url in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                out += page_records(f"{page_id}:{part}-{row}", page_id, url, payload or b"", ref, segment_bytes, ref_url)
                row += 1
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = pages.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        at = stop + 4
        if at + size > len(data):
            raise ValueError("record is cut short")
        yield headers, data[at : at + size]
        at += size
        if data[at : at + 4] != END:
            raise ValueError("record without its end")
        at += 4


RECORD = "id string, kind string, page_id long, refers_to long, digest string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record; ``id`` of a continuation is its origin's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for h, block in parse(content.as_buffer().to_pybytes()):
                    rows.append((h.get("warc-segment-origin-id") or h["warc-record-id"], h["warc-type"], number(h.get("x-page-id")), number(h.get("x-refers-to-page-id")), h.get("warc-payload-digest"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), block))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, ordered and verified; ``blocks`` has them in order.

    Only segmented records are shuffled. A group is one record's segments; a
    missing or repeated number, or a total that differs, gives ``whole`` false
    and the record is kept with what there is.
    """
    single = records.filter("segment is null").select("id", "kind", "page_id", "refers_to", "digest", F.array("block").alias("blocks"), F.lit(True).alias("whole"))
    parts = records.filter("segment is not null").groupBy("id").agg(
        F.min(F.when(F.col("segment") == 1, F.struct("kind", "page_id", "refers_to", "digest"))).alias("head"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    numbers = F.expr("transform(parts, p -> p.segment) = sequence(1, size(parts))")
    length = F.expr("aggregate(parts, 0L, (n, p) -> n + octet_length(p.block)) = total")
    return single.unionByName(parts.select("id", "head.kind", "head.page_id", "head.refers_to", "head.digest", F.col("parts.block").alias("blocks"), F.coalesce(numbers & length, F.lit(False)).alias("whole")))


def payloads(whole: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload).

    A response's payload is decoded from its framing and must match its
    digest; a revisit carries none, so its size and digest are those that its
    headers state. A record that is not whole raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, kind, ref, digest, blocks, ok in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if not ok:
                    raise ValueError(f"segments of page {page_id} don't add up")
                head, _, body = b"".join(blocks).partition(END)
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                stated = base64.b32decode(digest.removeprefix("sha1:")).hex()
                if kind == "revisit":
                    rows.append((page_id, int(http[b"content-length"]), stated, kind, ref, None))
                    continue
                payload = dechunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
                if hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"payload of page {page_id} doesn't match its digest")
                rows.append((page_id, len(payload), stated, kind, ref, payload))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return whole.select("page_id", "kind", "refers_to", "digest", "blocks", "whole").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def with_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, refers_to, refers_url) of pages (page_id, url, html).

    Of rows with equal payloads of at least ``least`` bytes, those with the
    largest page_id are responses and the others refer to it; a null page_id
    is smaller than all. If all ids of a group are null, all are responses.

    Smaller payloads are not shuffled. References are found without payloads,
    and join them by digest and page, so a payload that many pages share is
    spread over tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    small = F.octet_length("payload") < least
    large = rows.filter(~small).withColumn("digest", F.sha1("payload"))
    keeper = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    refers = large.select("digest", "page_id").distinct().join(keeper, "digest").filter("page_id is null or page_id <> refers_to")
    refers = refers.select(F.col("digest").alias("_digest"), F.col("page_id").alias("_page"), "refers_to", "refers_url")
    out = large.join(refers, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    plain = rows.filter(small).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    return out.select("page_id", "url", "payload", "refers_to", "refers_url").unionByName(plain)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    with _conf(spark, **{CLEANUP: "true"}):
        write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return payloads(reassemble(read_records(spark, path))).drop("payload")


QUERIES = {"op1_warc": op1_warc}
SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), g AS (
            SELECT html, max(page_id) AS keeper FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html
        )
        SELECT p.page_id,
               octet_length(encode(p.html)) AS payload_bytes,
               sha1(p.html) AS payload_digest,
               CASE WHEN g.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.keeper <> p.page_id THEN g.keeper END AS refers_to
        FROM p LEFT JOIN g ON g.html = p.html
    """,
}
