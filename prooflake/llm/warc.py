"""WARC archives: writing with deduplicated payloads and segmented records, reading with segment reassembly.

Writing.  A page becomes a ``response`` record (HTTP headers and the payload in chunked transfer framing) or, if a page
with a smaller id has the same payload, a ``revisit``.  Blocks over ``segment_bytes`` are split into a first segment
and ``continuation`` records.  Spark's text writer with the record separator as its line separator lays out plain
WARC/1.1 files, so the archives go to any store that Spark can write.

Reading.  Records are cut by Content-Length.  Segments are grouped by their origin's record id, ordered by segment
number, checked for gaps and against WARC-Segment-Total-Length, and joined, one page a group: repeated rows have equal
record ids, so their segments carry a mark of the row they come from; then the chunked framing is decoded and
the payload checked against WARC-Payload-Digest.

Defined cases: null html is an empty payload (equal to other empty payloads when ``min_bytes`` is 0); a null page_id
is always a response and comes back as null; null urls become ``urn:page``; repeated ids give a row each, judged by
their own payload (rows of the smallest id with it are all responses); an empty table gives no rows; further columns of
the input are ignored.  Damaged records raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 16 * 1024
#: Segments are bounded, so a file of so many records is too.
RECORDS_PER_FILE = 500
_CRLF = b"\r\n"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunked body without a last chunk")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) < n or body[at + n : at + n + 2] != _CRLF:
            raise ValueError("chunk shorter than its size")
        at += n + 2


def segments(block: bytes, most: int) -> list[bytes]:
    """Pieces of at most ``most`` bytes that don't cut a UTF-8 character."""
    out, at = [], 0
    while len(block) - at > most:
        end = at + most
        while end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def _record(kind: str, rid: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": "1970-01-01T00:00:00Z", **fields, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + _CRLF + block


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, segment_bytes: int = SEGMENT_BYTES, copy: str | None = None) -> list[bytes]:
    """The records of one page; ``first``: the page with the same payload that this one revisits.

    ``copy`` tells the segments of repeated rows apart, whose ids are equal.
    """
    digest = digest32(payload)
    rid = record_id(page_id, digest)
    uri = "urn:page" if url is None else "".join(url.split())
    named = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        named |= {"WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page-ID": first, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [_record("revisit", rid, named | {"Content-Type": "application/http; msgtype=response"}, http + b"Content-Length: %d\r\n\r\n" % len(payload))]
    parts = segments(http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload), segment_bytes)
    kind = {"Content-Type": "application/http; msgtype=response"}
    if len(parts) == 1:
        return [_record("response", rid, named | kind, parts[0])]
    out = [_record("response", rid, named | kind | {"WARC-Segment-Number": 1, "X-Copy": copy}, parts[0])]
    for k, p in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}/{k}')}>"
        last = sum(map(len, parts)) if k == len(parts) else None
        out.append(_record("continuation", own, {"WARC-Target-URI": uri, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": last, "X-Copy": copy}, p))
    return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, block
        at = end + 8 + n


def response_payload(block: bytes) -> bytes:
    """Payload of an HTTP response: dechunked if it is chunked."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = head.lower()
    return dechunk(body) if b"transfer-encoding: chunked" in fields else body


def join_segments(found: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments (number, total length, bytes) in any order; repeats of a number must be equal."""
    by = {}
    for k, total, part in sorted(found, key=lambda x: x[0]):
        if by.setdefault(k, (total, part)) != (total, part):
            raise ValueError(f"two different segments {k}")
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError(f"segments {sorted(by)}: one is missing")
    block = b"".join(p for _, p in by.values())
    if by[len(by)][0] != len(block):
        raise ValueError(f"segments have {len(block)} bytes, not {by[len(by)][0]}")
    return block


_PARSED = "origin string, copy string, page_id long, record_type string, refers_to long, digest string, segment int, total long, payload_bytes long, block binary, payload binary"
_ROWS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _checked(block: bytes, digest: str) -> bytes:
    payload = response_payload(block)
    if digest32(payload) != digest:
        raise ValueError(f"payload doesn't have the digest {digest}")
    return payload


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_PA = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _PA[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _parser(with_payload: bool):
    schema = _schema(_PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                rows, held = [], 0
                for head, block in parse_records(value.as_py()):
                    kind, number = head["warc-type"], head.get("warc-segment-number")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    page = None if (p := head.get("x-page-id")) is None else int(p)
                    ref = None if (p := head.get("x-refers-to-page-id")) is None else int(p)
                    total = None if (p := head.get("warc-segment-total-length")) is None else int(p)
                    if kind == "continuation" or number is not None:
                        rows.append((head.get("warc-segment-origin-id", head["warc-record-id"]), head.get("x-copy"), page, kind, ref, digest, int(number), total, None, block, None))
                        held += len(block)
                    elif kind == "revisit":
                        n = next(int(x.split(b":")[1]) for x in block.split(_CRLF) if x.lower().startswith(b"content-length:"))
                        rows.append((head["warc-record-id"], None, page, kind, ref, digest, None, None, n, None, None))
                    elif kind == "response":
                        payload = _checked(block, digest)
                        rows.append((head["warc-record-id"], None, page, kind, ref, digest, None, None, len(payload), None, payload if with_payload else None))
                        held += len(payload) * with_payload
                    if held > 8 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return run


def _joiner(with_payload: bool):
    schema = _schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = r["found"]
                head = [x for x in found if x["segment"] == 1]
                payload = _checked(join_segments([(x["segment"], x["total"], x["block"]) for x in found]), head[0]["digest"])
                rows += [(h["page_id"], "response", None, len(payload), h["digest"], payload if with_payload else None) for h in head]
            if rows:
                yield _batch(rows, schema)

    return run


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, d, refers_to) of pages whose payload (digest d, ``min_bytes`` at least) a page of smaller id has."""
    payload = _payload()
    marks = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("d"), F.octet_length(payload).alias("n")).where(f"n >= {int(min_bytes)}").select("page_id", "d")
    first = marks.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("refers_to < most").select("d", "refers_to")
    return marks.join(first, "d").where("page_id > refers_to").select("page_id", "d", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, refers: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> None:
    """WARC files under ``path``: one record per page, more for long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, first in zip(*(batch.column(k) for k in ("page_id", "url", "html", "refers_to")), strict=True):
                new = page_records(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), first.as_py(), segment_bytes, f"{part}/{row}")
                row += 1
                out += new
                held += sum(map(len, new))
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(_payload()).alias("d")).join(refers, ["page_id", "d"], "left")
    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows (page_id, record_type, refers_to, payload_bytes, payload_digest, payload), one per response or revisit."""
    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parser(with_payload), _PARSED)
    # whole records pass by; only segments are grouped, by their origin and, in archives written here, their row
    one = F.struct("segment", "total", "block", "page_id", "digest")
    whole = parsed.where("segment IS NULL").select("page_id", "record_type", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"), "payload")
    parts = parsed.where("segment IS NOT NULL").groupBy("origin", "copy").agg(F.collect_list(one).alias("found")).select("found")
    return whole.unionByName(parts.mapInArrow(_joiner(with_payload), _ROWS))


def op3_warc(spark: SparkSession, sf_dir: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """All pages written as WARC and read back."""
    keep = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    refers = keep.keep(revisits(pages), "revisits")
    write_archives(pages, keep.path("archives"), refers, segment_bytes)
    return read_archives(spark, keep.path("archives"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
