"""WARC archives: one gzip member per record, written by Spark's file committer and read back sequentially.

Writing. Each page is one record in one gzip member. A page whose payload another page has too becomes a ``revisit`` of
the page with the largest id; its record holds no payload. Members go out through Spark's text writer, so that the output
commits per task and a lost executor leaves no half archive. The writer ends each row with a separator; the separator
here is one zero byte, which is what a gzip member ends with anyway (the top byte of its length field) whenever the
record is below 16 MiB. The member is handed over without that byte. Longer members are handed over whole, and the zero
byte is padding between members, which the reader skips.

Archives are cut at about ``archive_bytes``, between records.

Reading. A task takes an archive, feeds it to zlib piece by piece, frames the record by its content length, and verifies
block and payload digests. It holds the packed archive (whose size is bounded as it was written) and one unpacked record at a time.

Defined cases: null html is an empty payload; null ids and urls leave their header out; rows that repeat the largest id
with the same payload are all responses; an empty table gives an empty archive folder; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, lean, settle, table, work_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Payload digests that several pages share, with the page they refer to. Only ids and digests are shuffled, after a
    partial aggregation, so a payload that a third of all pages share costs a row per task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return (
        pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
        .where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").select("sha", "first_id", F.lit(True).alias("shared"))
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, archive_bytes: int = 16 << 20) -> None:
    """Writes archives under ``path/cut=k``, one for each task and ``archive_bytes``. ``min_bytes``: smaller payloads are never revisits."""
    shared = settle(revisits(pages, min_bytes), "revisits")
    rows = (
        pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
        .withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(shared, "sha", "left")
        .select("page_id", "url", "html", F.col("first_id").alias("refers_to"), (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("html") >= min_bytes)).alias("revisit"))
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda cuts, out: pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array(out, pa.binary())], ["cut", "member"])
        cut, size = 0, 0
        for batch in batches:
            out, cuts, held = [], [], 0
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() if c.type != pa.string() else c for c in batch.columns), strict=True):
                payload = html.as_py().encode()
                m = _member(_record(page_id, url.as_py(), payload, _sha1(payload), refers_to, revisit, date), level)
                cut, size = (cut + 1, len(m)) if size and size + len(m) > archive_bytes else (cut, size + len(m))
                out.append(m[:-1] if m[-1:] == b"\0" else m)
                cuts.append(cut)
                held += len(m)
                if held > 4 << 20:
                    yield pack(cuts, out)
                    out, cuts, held = [], [], 0
            yield pack(cuts, out)

    rows.mapInArrow(lean(members), "cut int, member binary").select("cut", F.col("member").cast("string").alias("value")).write.partitionBy("cut").option("lineSep", "\0").text(path)
    drop(shared)


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def records(data: bytes, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, in order. Raises ValueError on bad framing or a wrong digest."""
    view, at, z, held = memoryview(data), 0, None, bytearray()
    while at < len(view):
        if z is None:
            if view[at] == 0:  # padding between members
                at += 1
                continue
            z, held = zlib.decompressobj(31), bytearray()
        chunk = view[at : at + step]
        held += z.decompress(chunk)
        at += len(chunk) - len(z.unused_data)
        if not z.eof:
            continue
        z, end = None, held.find(b"\r\n\r\n")
        head = _headers(bytes(held[:end])) if end >= 0 else {}
        if not head.get("", "").startswith("WARC/") or not head.get("content-length", "").isdigit():
            raise ValueError("a gzip member holds no WARC record")
        length = int(head["content-length"])
        block = bytes(held[end + 4 : end + 4 + length])
        if len(block) != length or bytes(held[end + 4 + length :]) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} is not framed by its content length")
        if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{_sha1(block)}":
            raise ValueError(f"record {head.get('warc-record-id')} has another block digest")
        yield head, block
    if z is not None:
        raise ValueError("the archive ends inside a gzip member")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record under ``path``. Payload sizes and digests are those of the full payload, for revisits too."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for cell in batch.column(0):
                rows, held = [], 0
                for head, block in records(cell.as_buffer()):
                    end = block.find(b"\r\n\r\n") + 4
                    size, payload, revisit = int(_headers(block[: end - 4])["content-length"]), block[end:], head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != size or _sha1(payload) != digest):
                        raise ValueError(f"record {head.get('warc-record-id')} has another payload digest")
                    number = lambda k: int(head[k]) if head.get(k, "None") != "None" else None  # noqa: B023, E731
                    rows.append((number("warc-page-id"), head.get("warc-target-uri"), head["warc-type"], size, digest, number("warc-refers-to-page-id"), payload if with_payload and not revisit else None))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(lean(parsed), RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS top_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top_id THEN NULL ELSE top_id END AS refers_to
FROM q"""
