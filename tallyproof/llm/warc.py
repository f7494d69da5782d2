"""WARC archives: writing with segmentation and revisits, and reading back.

A record holds an HTTP response whose payload is sent in chunks. A block of more
than `segment_bytes` is cut: the response record carries segment 1, continuation
records carry the others, and the last one the total length. The reader gives
whole records as they are; segments go to one place by the identifier of their
origin, are put in order of their numbers, must add up to the total length, and
only then is the chunked framing undone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, filesystem, one_each, small_or_not, workspace, written

REVISIT_LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undoes chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(map(str, parts)).encode()).digest()[:16], version=4)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_records(page_id: object, url: str | None, payload: bytes, digest: str, origin: object, revisit: bool, key: tuple, segment_bytes: int) -> Iterator[bytes]:
    own = _urn("record", *key)
    target = "urn:page" if url is None else "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in url)
    base = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), *([("Page-Id", quote(str(page_id), ""))] if page_id is not None else [])]
    kind = ("Content-Type", "application/http;msgtype=response")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        more = [("WARC-Profile", PROFILE), ("Refers-To-Page-Id", quote(str(origin), "")), ("Payload-Length", str(len(payload)))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *base, *more, kind], head)
        return
    block = head + chunked(payload)
    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *base, kind, *([("WARC-Segment-Number", "1")] if len(cut) > 1 else [])], cut[0])
    for n, part in enumerate(cut[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(cut) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", _urn("segment", n, *key)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last], part)


def _write(path: str, segment_bytes: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names: list[str] = []
        out, size, row = None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, origin, revisit in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "origin", "revisit")), strict=True):
                row += 1
                for rec in page_records(page_id, url, (html or "").encode(), digest, origin, revisit, (part, attempt, row), segment_bytes):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        else:
                            fs.create_dir(folder, recursive=True)
                        names.append(f"pages-{part:06d}-{len(names):04d}-{attempt}.warc.gz")
                        out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    out.write(rec)
                    size += len(rec)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(names)], ["file"])

    return run


def write_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, segment_bytes: int = 16 << 10, file_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Writes the archives; gives their folder and the table of their names."""
    spark = df.sparkSession
    arrow_limits(spark)
    path = path or workspace(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    keys = df.select(F.col(id_col).alias("id"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= REVISIT_LEAST)
    copies = keys.groupBy("digest").agg(F.min("id").alias("origin"), F.count("*").alias("n")).where("n > 1 and origin is not null").drop("n")
    rows = rows.join(small_or_not(written(copies, "copies")), "digest", "left")
    rows = rows.withColumn("revisit", F.col("origin").isNotNull() & ~F.col("id").eqNullSafe(F.col("origin")))
    files = rows.select("id", "url", "html", "digest", "origin", "revisit").mapInArrow(_write(path, segment_bytes, file_bytes), "file string")
    return path, written(files, "warc-files")


def parse(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive of one gzip member each, read as a stream."""
    packed = b""
    unpacker, parts = zlib.decompressobj(31), []
    while True:
        if not packed:
            packed = source.read(1 << 20)
            if not packed:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
        parts.append(unpacker.decompress(packed))
        packed = unpacker.unused_data
        if unpacker.eof:
            raw = b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
            end = raw.index(b"\r\n\r\n")
            lines = raw[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers["content-length"])
            block = raw[end + 4 : end + 4 + size]
            if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield headers, block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


PAGES = "page_id string, type string, refers_to string, payload binary, digest string, length long"
#: What one pass over the archives gives: whole records as pages; segments with their blocks, to be joined.
RECORDS = f"{PAGES}, origin string, segment int, total long, block binary"
_PAGE_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
_RECORD_TYPES = [*_PAGE_TYPES, pa.string(), pa.int32(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in names.split(", ")])


def _decoded(page: str | None, kind: str, refers: str | None, digest: str | None, length: int | None, block: bytes, payloads: bool) -> tuple:
    if kind == "revisit":
        return page, kind, refers, None, digest, length
    payload = payload_of(block)
    found = hashlib.sha256(payload).hexdigest()
    if digest is not None and found != digest:
        raise ValueError(f"payload of page {page} doesn't match its digest")
    return page, kind, refers, payload if payloads else None, found, len(payload)


def _read(path: str, payloads: bool):
    def text(h: dict[str, str], name: str) -> str | None:
        return unquote(h[name]) if name in h else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as source:
                    for h, block in parse(source):
                        number = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                        total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                        length = int(h["payload-length"]) if "payload-length" in h else None
                        page = text(h, "page-id"), h["warc-type"], text(h, "refers-to-page-id")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        if number is None:
                            held.append((*_decoded(*page, digest, length, block, payloads), None, None, None, None))
                            size += len(block) if payloads else 500
                        else:
                            held.append((*page, None, digest, length, h.get("warc-segment-origin-id", h["warc-record-id"]), number, total, block))
                            size += len(block)
                        if size > 4 << 20:
                            yield _batch(held, RECORDS, _RECORD_TYPES)
                            held, size = [], 0
                if held:
                    yield _batch(held, RECORDS, _RECORD_TYPES)

    return run


def read_records(spark, path: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives: whole ones decoded and checked (without the
    payload, if it isn't asked for), segments with their blocks."""
    return one_each(files).mapInArrow(_read(path, payloads), RECORDS)


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """Segments (number, total or None, block) in any order, to the whole block."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] != len(block):
        raise ValueError("segments are missing, repeated, or don't add up to the total length")
    return block


def _joined(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by origin and number."""
        origin, parts, first = None, [], None
        for batch in batches:
            done = []
            names = ("origin", "segment", "total", "type", "page_id", "refers_to", "digest", "length", "block")
            for o, n, total, kind, page, refers, digest, length, block in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if o != origin and parts:
                    done.append(_decoded(*first, join_segments(parts), payloads))
                    parts = []
                if not parts:
                    first = (page, kind, refers, digest, length)
                origin = o
                parts.append((n, total, block))
            yield _batch(done, PAGES, _PAGE_TYPES)
        if parts:
            yield _batch([_decoded(*first, join_segments(parts), payloads)], PAGES, _PAGE_TYPES)

    return run


def read_pages(spark, path: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, type, refers_to, payload, digest, length), one row for each page
    record. The archives are read once; what they hold is written, so that whole
    records and segments both come from there. Without `payloads` that is little."""
    records = written(read_records(spark, path, files, payloads), "records")
    whole = records.where("segment is null").select(*(c.split()[0] for c in PAGES.split(", ")))
    split = records.where("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_joined(payloads), PAGES)
    return whole.unionByName(split)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **kw) -> DataFrame:
    """Writes a record for each row, reads the archives back, and gives
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least 100 bytes, the rows with the smallest id that
    isn't null are responses and the others revisit it; if all their ids are null,
    all are responses. A null html is empty; a null id stays null; repeated rows
    have records of their own. An empty table writes no archive and gives no row.
    Other columns are not looked at. Very long payloads are many segments.
    """
    path, files = write_pages(df, id_col, url_col, html_col, **kw)
    kind = df.schema[id_col].dataType
    pages = read_pages(df.sparkSession, path, files, payloads=False)
    return pages.select(F.col("page_id").cast(kind).alias(id_col), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


WARC_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT digest, min(page_id) AS origin FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN m.origin IS NULL OR p.page_id = m.origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.origin IS NULL OR p.page_id = m.origin THEN NULL ELSE m.origin END AS refers_to
FROM p LEFT JOIN m ON p.digest = m.digest
"""
