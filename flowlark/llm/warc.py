"""WARC archives of web pages: a writer with revisit records and a reader that salvages damaged files.

Archives are written through Spark's own file writer, so they can lie in any
store Spark reaches: each row of the ``text`` writer is a chunk of whole
records. Compressed files hold one gzip member a record, and the separator
between chunks is an empty member; plain files have the records' own end,
CR LF CR LF, as separator. Both are standard files for any WARC reader.

The reader takes each file as a whole (the writer bounds their size). A record
is good if its header parses, its block has the stated length and end, and the
stated digests hold; otherwise the reader looks for the next gzip member or
version line at which a good record begins, goes on there, and logs the bytes
between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm.common import fresh_path

_END = b"\r\n\r\n"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedRecord(ValueError):
    """A record or member that fails a check."""


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record without its end; a revisit if ``refers_to`` is given (its block then has no payload)."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response"
    lines = []
    if refers_to is None:
        block += payload or b""
    else:
        kind = "revisit"
        lines = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"X-Page-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_one_line(url)}"] if url else []),
        *lines,
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _END + block


def _whole(value: str) -> int | None:
    """A number of up to 18 ASCII digits, which fits 64 bits; anything else is none."""
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else None


def _page(value: str) -> int | None:
    """The id of a page as it was written; one that does not fit 64 bits is none."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", value)
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _labelled(stated: str) -> tuple[str, str]:
    """Algorithm (SHA-1 if none is named) and value of a digest field."""
    name, colon, value = stated.partition(":")
    return (name.strip().lower().replace("-", ""), value.strip()) if colon else ("sha1", stated)


def _fails(stated: str, content: bytes) -> bool:
    """Whether a stated digest, hex of any case or base32, is not that of ``content``; unknown algorithms are not checked."""
    name, value = _labelled(stated)
    if not value or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return False
    found = hashlib.new(name, content).digest()
    return value.lower() != found.hex() and value.upper().rstrip("=") != base64.b32encode(found).decode().rstrip("=")


def _as_hex(stated: str) -> str | None:
    """A stated SHA-1 as lower-case hex without its label, others as they are."""
    name, value = _labelled(stated)
    if name != "sha1":
        return stated or None
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value.lower() or None


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and the place after its end."""
    end = data.find(_END, at) if data.startswith(_VERSION, at) else -1
    if end < 0:
        raise DamagedRecord("no record header")
    fields, lines = {}, []
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()  # a folded header goes on
        else:
            lines.append(line)
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise DamagedRecord("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
    length = _whole(fields.get("content-length", ""))
    if length is None:
        raise DamagedRecord("no content length")
    start = end + 4
    stop = start + length
    if stop > len(data) or data[stop : stop + 4] not in (_END, b""):
        raise DamagedRecord("the block has not the stated length")
    block = data[start:stop]
    if _fails(fields.get("warc-block-digest", ""), block):
        raise DamagedRecord("block digest")
    kind = fields.get("warc-type", "")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block[block.find(_END) + 4 :] if _END in block else b""
    stated = fields.get("warc-payload-digest", "")
    size = fields.get("x-payload-length", "")
    if kind == "revisit":
        digest, size = _as_hex(stated), _whole(size)
    else:
        if _fails(stated, payload):
            whole = _unchunked(payload) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked", block[: block.find(_END) + 2]) else None
            if whole is None or _fails(stated, whole):
                raise DamagedRecord("payload digest")
            payload = whole  # the digest is that of the entity, as it was before its transfer
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    out = {"record_type": kind, "page_id": _page(fields.get("x-page-id", "")), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to", "")), "payload": payload if kind != "revisit" else None}
    return out, min(stop + 4, len(data))


def _unchunked(body: bytes) -> bytes | None:
    """The entity of a chunked body, or None if it is none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(;.*)?", body[at:end]) if end >= 0 else None
        if size is None:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) < n:
            return None
        out.append(part)
        at = end + 2 + n
        if body[at : at + 2] == b"\r\n":
            at += 2


_INFLATED = 1 << 14  # stored bytes between two marks


def _member(data: memoryview, at: int) -> tuple[bytes, int, str, list[tuple[int, int]]]:
    """Of the gzip member at ``at``: its text, the place after it, what is wrong with it, and marks (bytes of text, place they came from).

    A damaged member gives all text before the damage; the place is then that of the damage.
    """
    inflate, out, size, place, marks = zlib.decompressobj(31), [], 0, at, []
    while not inflate.eof and place < len(data):
        part, before = data[place : place + _INFLATED], inflate.copy()
        marks.append((size, place))
        try:
            out.append(inflate.decompress(part))
        except zlib.error as error:
            for k in range(len(part)):  # what the bytes before the damage hold
                try:
                    out.append(before.decompress(part[k : k + 1]))
                except zlib.error:
                    place += k
                    break
            return b"".join(out), place, f"gzip: {error}", marks
        size += len(out[-1])
        place += len(part)
    if not inflate.eof:
        return b"".join(out), place, "gzip: the member does not end", marks
    return b"".join(out), place - len(inflate.unused_data), "", marks


def _records(text: bytes) -> tuple[list[dict], str, int]:
    """The good records of a member's text, what is wrong with the first other one, and the place after the last good one."""
    got, bad, at, done = [], "", 0, 0
    while at < len(text):
        try:
            record, at = _parse(text, at)
            got.append(record)
            done = at
        except DamagedRecord as error:
            bad = bad or str(error)
            follow = text.find(_VERSION, at + 1)
            at = follow if follow >= 0 else len(text)
    return got, bad, done


def salvage(data: bytes) -> Iterator[tuple[str, dict | tuple[int, int, str]]]:
    """('record', fields) of each good record and ('gap', (offset, length, reason)) of each run of bytes that is none.

    Offsets count in the file as stored. A member that holds damaged records
    still gives its good ones; it is logged as one gap. A member that cannot be
    read to its end gives the records before the damage; the gap begins where
    the text after the last of them came from.
    """
    view, at, gap, why = memoryview(data), 0, None, ""
    while at < len(view):
        try:
            got, spoilt = [], None
            if view[at : at + 3] == _MAGIC:
                text, after, broken, marks = _member(view, at)
                got, bad, done = _records(text)
                if broken:
                    if not got:
                        raise DamagedRecord(broken)
                    rest = max(at + 1, max((place for size, place in marks if size <= done), default=at))
                    follow = _NEXT.search(data, rest)
                    after = follow.start() if follow else len(view)
                    spoilt = (rest, after - rest, broken)
                elif bad:
                    spoilt = (at, after - at, bad)
            else:
                record, after = _parse(data, at)
                got.append(record)
        except DamagedRecord as error:
            if gap is None:
                gap, why = at, str(error)
            follow = _NEXT.search(data, at + 1)
            at = follow.start() if follow else len(view)
            continue
        if gap is not None:
            yield "gap", (gap, at - gap, why)
            gap = None
        if spoilt:
            yield "gap", spoilt
        for record in got:
            yield "record", record
        at = after
    if gap is not None:
        yield "gap", (gap, len(view) - gap, why)


def _writer(date: str, compression: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            joined = b"".join(held) if compression == "gzip" else _END.join(held)
            return pa.record_batch([pa.array([joined], pa.binary())], names=["value"])

        for batch in batches:
            for page, url, payload, digest, length, refers in zip(*(batch.column(k) for k in range(6))):
                payload = payload.as_buffer().to_pybytes() if payload.is_valid else b""
                data = record_bytes(page.as_py(), url.as_py(), payload, digest.as_py(), length.as_py(), refers.as_py(), date)
                if compression == "gzip":
                    data = gzip.compress(data + _END, 3, mtime=0)
                held.append(data)
                size += len(data)
                if size >= chunk:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return run


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, compression: str = "gzip", date: str | None = None, archive_mb: int = 32) -> None:
    """Write a record for each row to archives under ``path``.

    Of records with equal payloads (by SHA-1) of ``least`` bytes or more, the
    one with the largest id is a response, the others revisit it; all others
    are responses. A null payload is empty, a null id is written as none and a
    null url is left out. Rows that repeat the largest id are all responses.
    An empty table writes no record. Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # grouped by two keys and joined by one: both sides are dealt anew, and a hot payload can be split
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(groups, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers.alias("refers_to"))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    chunks = rows.mapInArrow(_writer(date, compression, 1 << 20), "value binary")
    separator = _EMPTY_MEMBER if compression == "gzip" else _END
    # the writer puts out the bytes of a string as they are
    chunks.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("maxRecordsPerFile", archive_mb).text(path)


RECORD_SCHEMA = "kind string, file string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_offset long, gap_bytes long, gap_reason string"


def _reader(with_payload: bool):
    fields = pa.schema([("kind", pa.string()), ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_offset", pa.int64()), ("gap_bytes", pa.int64()), ("gap_reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for kind, got in salvage(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    row = dict.fromkeys(fields.names) | {"kind": kind, "file": file.as_py()}
                    if kind == "record":
                        row |= got if with_payload else {k: v for k, v in got.items() if k != "payload"}
                        size += len(row["payload"] or b"")
                    else:
                        row |= dict(zip(("gap_offset", "gap_bytes", "gap_reason"), got))
                    rows.append(row)
                    if len(rows) >= 2000 or size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return run


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """All good records (``kind`` = record) and logged gaps (``kind`` = gap) of the archives under ``path``.

    Compressed and plain files, or mixtures, are told by their bytes. An empty
    file gives nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, *, least: int = 1000, compression: str = "gzip") -> DataFrame:
    """The pages' records as read back from archives in the shared folder; a gap in them raises an error."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, least=least, compression=compression)
    gap = F.raise_error(F.concat(F.lit("bytes of an own archive cannot be read: "), F.coalesce("gap_reason", F.lit("?"))))
    records = read_warc(spark, path, with_payload=False).where(F.when(F.col("kind") == "record", F.lit(True)).otherwise(gap.cast("boolean")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
