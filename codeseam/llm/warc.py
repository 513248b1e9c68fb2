"""WARC archives with revisit records.

Archives are written by Spark's text writer (one record to a line, ``\\r\\n\\r\\n`` between records, gzip) and read back
as whole files whose records are cut by their Content-Length, so any file system that Spark reaches will do and payloads
may hold anything.  Steps: headers (digest and length of every payload) are shuffled by payload digest; the first record
of a digest (smallest page id, then record id) is the original, the rest are joined to it; then every record is written
with fresh headers, revisits without payload.  Records come from a table of pages or from archives that exist already.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import record_batch, shared_path, text_bytes, written

BREAK = "\r\n\r\n"
#: Aim for archives of about so many raw bytes.
ARCHIVE_BYTES = 48 << 20
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(s: str) -> str:
    return _BAD.sub(lambda m: f"%{ord(m[0]):02X}", s)


def build_record(page_id, url, payload: bytes | None, digest: str, size: int, record_id: str, refers: tuple | None = None) -> str:
    """One record without the break that ends it.  ``refers``: (page_id, url, record_id) of the original."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{BREAK}"
    body = http if refers else http + (payload or b"").decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{refers[2]}>",
            f"WARC-Refers-To-Target-URI: {_header_value(refers[1]) if refers[1] else f'urn:page:{refers[0]}'}",
            f"WARC-Refers-To-Date: {DATE}",
        ]
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page-Id: {refers[0]}")
    head.append(f"Content-Length: {len(body.encode())}")
    return "\r\n".join(head) + BREAK + body


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip or plain archive, a piece at a time."""
    unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
    held, at = b"", 0

    def more() -> bool:
        nonlocal held, at, unzip
        if at >= len(data):
            return False
        piece = data[at : at + (1 << 20)]
        at += len(piece)
        if unzip is None:
            held += piece
            return True
        parts = []
        while piece:
            parts.append(unzip.decompress(piece))
            piece = unzip.unused_data
            if piece:  # the next gzip member
                unzip = zlib.decompressobj(31)
        held += b"".join(parts)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(head["content-length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                if len(held) < end + 4 + size:
                    raise ValueError("an archive ends inside a record")
                break
        yield head, held[end + 4 : end + 4 + size]
        held = held[end + 4 + size + 4 :]


_READ = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
     ("size", pa.int64()), ("refers_id", pa.string()), ("refers_page", pa.int64()), ("payload", pa.string())]
)
_READ_DDL = "record_id string, kind string, page_id bigint, url string, digest string, size bigint, refers_id string, refers_page bigint, payload string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record's headers, with its payload where asked for (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                for head, block in parse_archive(batch.column(0)[k].as_py()):
                    kind = head["warc-type"]
                    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and (len(payload) != int(head["x-payload-length"]) or payload_digest(payload) != digest):
                        raise ValueError(f"a payload differs from its digest: {head['warc-record-id']}")
                    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    rows.append(
                        (head["warc-record-id"][10:-1], kind, page and int(page), head["warc-target-uri"], digest, int(head["x-payload-length"]),
                         head["warc-refers-to"][10:-1] if "warc-refers-to" in head else None, refers and int(refers),
                         payload.decode() if payloads and payload is not None else None)
                    )
                    held += len(block) if payloads else 200
                    if held >= BATCH_BYTES:
                        yield record_batch(_READ, *zip(*rows))
                        rows, held = [], 0
            if rows:
                yield record_batch(_READ, *zip(*rows))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _READ_DDL)


def _write(df: DataFrame, path: str, per_file: int) -> None:
    """``df`` has one string column of records."""
    df.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_TEXT = pa.schema([("value", pa.string())])


_HEADERS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64())])
_HEADERS_DDL = "record_id string, page_id bigint, url string, digest string, size bigint"


def page_headers(pages: DataFrame) -> DataFrame:
    """Headers of the records to be, from rows of record_id, page_id, url, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = list(text_bytes(batch.column(3)))
            yield record_batch(_HEADERS, *batch.columns[:3], [payload_digest(x) for x in data], [len(x) for x in data])

    return pages.select("record_id", "page_id", "url", "payload").mapInArrow(run, _HEADERS_DDL)


def resolve(headers: DataFrame, least_bytes: int = 0, salts: int = 64) -> DataFrame:
    """(record_id, o_page, o_url, o_record, o_digest, o_size) of the records that revisit another one, and that one.

    Headers are reduced to each digest's first record before they meet; only digests that several records share are
    joined back, over ``salts`` parts of each, so one very common payload is spread.
    """
    wide = headers.filter(F.col("size") >= least_bytes)
    first = wide.groupBy("digest", "size").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url")).alias("o")
    )
    shared = first.filter("n > 1").select("digest", "size", "o", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = wide.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    return dealt.join(shared, ["digest", "size", "salt"]).filter("record_id <> o.record_id").select(
        "record_id", F.col("o.page_id").alias("o_page"), F.col("o.url").alias("o_url"), F.col("o.record_id").alias("o_record"),
        F.col("digest").alias("o_digest"), F.col("size").alias("o_size"),
    )


def write_resolved(records: DataFrame, headers: DataFrame, path: str, per_file: int, least_bytes: int = 0, salts: int = 64) -> None:
    """Write archives of ``records`` (record_id, page_id, url, payload) with the revisits that ``headers`` show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, page, url, o_page, o_url, o_record, o_digest, o_size = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7, 8))
            out, held = [], 0
            for k in range(batch.num_rows):
                fresh = str(uuid.uuid5(uuid.NAMESPACE_URL, "fresh:" + name[k]))
                if o_record[k]:
                    refers = (o_page[k], o_url[k], str(uuid.uuid5(uuid.NAMESPACE_URL, "fresh:" + o_record[k])))
                    out.append(build_record(page[k], url[k], None, o_digest[k], o_size[k], fresh, refers))
                else:
                    data = (batch.column(3)[k].as_py() or "").encode()
                    out.append(build_record(page[k], url[k], data, payload_digest(data), len(data), fresh))
                held += len(out[-1])
                if held >= BATCH_BYTES:
                    yield record_batch(_TEXT, out)
                    out, held = [], 0
            yield record_batch(_TEXT, out)

    revisits = resolve(headers, least_bytes, salts)
    joined = records.select("record_id", "page_id", "url", "payload").join(revisits, "record_id", "left")
    _write(joined.mapInArrow(run, "value string"), path, per_file)


def deduplicate(spark: SparkSession, raw_path: str, path: str, per_file: int, least_bytes: int = 0, salts: int = 64) -> None:
    """Read the archives at ``raw_path`` and write them again at ``path`` with revisits resolved."""
    headers = written(
        spark, read_archives(spark, raw_path, payloads=False).select("record_id", "page_id", "url", "digest", "size"), "warc-headers"
    )
    write_resolved(read_archives(spark, raw_path), headers, path, per_file, least_bytes, salts)


def archive_pages(spark: SparkSession, pages: DataFrame, path: str, row_key: str | None = None, least_bytes: int = 0) -> None:
    """Write a record for every row of page_id, url, html.

    ``row_key`` names a column that tells rows apart and stays the same whenever the table is read; without one the rows
    are numbered in a written copy.
    """
    count, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.length("html")), F.lit(0))).first()
    per_file = max(1, int(ARCHIVE_BYTES // max(512, size // max(1, count))))
    key = F.col(row_key) if row_key else F.monotonically_increasing_id().cast("string")
    rows = pages.select(key.alias("record_id"), F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").alias("payload"))
    rows = rows if row_key else written(spark, rows, "warc-pages")
    write_resolved(rows, written(spark, page_headers(rows), "warc-headers"), path, per_file, least_bytes)


def revisit_archives(spark: SparkSession, pages: DataFrame, row_key: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from the archives written of ``pages``.

    Null html is the empty payload, null urls get a URN.  Null page ids sort last among equals and refer like others.
    Repeated rows are records of their own; of equal page ids the smaller record id is the original.  Other columns are
    not read.
    """
    path = shared_path(spark, "warc")
    archive_pages(spark, pages, path, row_key, least_bytes)
    return read_archives(spark, path, payloads=False).select(
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )
