"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes one WARC/1.1 record a row, each a gzip member of its own (or plain), and hands them to Spark's text writer, whose
commit protocol and file systems they share. A record is written without its last byte, which the writer's line separator
supplies: NUL for a gzip member (the top byte of a length below 16 MiB; a longer record is followed by an empty member), LF for a plain record.

The reader takes any WARC files, plain or gzip by member. Each record is checked: its member's checksum, version line, Content-Length, the blank lines
after the block, and the block digest if it has one. After a failed check the bytes from there on are quarantined up to the next offset at which a member starts that
opens with a version line, or a plain version line at the start of a line; later records are recovered, and each gap
is reported with its bytes and reason. A member may hold any number of records of any size: its records are read one after the other, a gap among them is searched for the next version line alike, and
all of them have the member's place in the file. Content beyond ``IN_MEMORY`` bytes is unpacked to a scratch file of the task. A file is one row, so its packed bytes have to fit a task's memory; the writer bounds files by ``FILE_RECORDS``.

Defined cases: null html is an empty payload; of equal payloads of at least ``MIN_REVISIT`` bytes the largest page_id is the response (null ids only if there is no
other; of repeated rows one); an empty table writes no records and reads back as no rows; an empty file has neither records nor gaps.
"""

from __future__ import annotations

import hashlib
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.common import lookup, shared_table

MIN_REVISIT, FILE_RECORDS, LEVEL = 1000, 10_000, 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
IN_MEMORY, STEP = 64 << 20, 1 << 16
READ_SCHEMA = "file string, start long, end long, status string, reason string, headers map<string,string>, payload_bytes long, payload_sha1 string"


# --- records ---------------------------------------------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One plain record; length and block digest are added."""
    digest = hashlib.sha1(block).hexdigest()
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {_flat(v)}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _flat(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def member(plain: bytes, level: int = LEVEL) -> bytes:
    """A gzip member (always the same bytes for the same record) that ends in NUL."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(plain) + packer.flush()
    if packed[-1]:
        empty = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed += empty.compress(b"") + empty.flush()
    return packed


class Damaged(ValueError):
    """A check that failed."""


def parse(data: bytes | mmap.mmap, at: int) -> tuple[dict[str, str], memoryview, int]:
    """Headers, block and end of the record at an offset of plain bytes."""
    if not re.match(rb"WARC/1\.", memoryview(data)[at : at + 7]):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("headers without an end")
    headers: dict[str, str] = {}
    for line in bytes(data[at:head_end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged("malformed header")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no Content-Length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where Content-Length says")
    block = memoryview(data)[start:end]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and re.fullmatch("[0-9a-f]{40}", digest) and hashlib.sha1(block).hexdigest() != digest:
        raise Damaged("block digest differs")
    return headers, block, end + 4


def unpack(data: memoryview, at: int) -> tuple[bytes | mmap.mmap, int]:
    """The content and the end of the gzip member at an offset; input goes in by steps, so no tail is copied, and long content into a file."""
    reader, out = zlib.decompressobj(31), tempfile.SpooledTemporaryFile(IN_MEMORY)
    with out:
        while not reader.eof:
            step = data[at : at + STEP]
            if not len(step):
                raise Damaged("member without an end")
            try:
                while True:  # a step may unpack to a thousand times its size
                    out.write(reader.decompress(step, 1 << 24))
                    if reader.eof or not reader.unconsumed_tail:
                        break
                    at += len(step) - len(reader.unconsumed_tail)
                    step = reader.unconsumed_tail
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            at += len(step) - len(reader.unused_data)
        if out.tell() <= IN_MEMORY:
            out.seek(0)
            return out.read(), at
        out.flush()
        return mmap.mmap(out.fileno(), 0, access=mmap.ACCESS_READ), at


_CANDIDATE = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/1\.[0-9]\r\n")


def _next_start(data: bytes, at: int) -> int:
    """The next offset at which a record seems to start, or the end."""
    for found in _CANDIDATE.finditer(data, at):
        if data[found.start()] != 0x1F:
            return found.start()
        try:
            if zlib.decompressobj(31).decompress(memoryview(data)[found.start() : found.start() + 512], 16).startswith(b"WARC/1."):
                return found.start()
        except zlib.error:
            continue
    return len(data)


_VERSION = re.compile(rb"(?<=\n)WARC/1\.[0-9]\r\n")

Found = tuple[int, int, str | None, dict[str, str], memoryview | bytes]


def _member(plain: bytes | mmap.mmap, start: int, end: int) -> Iterator[Found]:
    """The records and gaps of an unpacked member, which lies from start to end."""
    at = 0
    while at < len(plain):
        try:
            headers, block, at = parse(plain, at)
            yield start, end, None, headers, block
        except Damaged as e:
            following = _VERSION.search(plain, at + 1)
            after = following.start() if following else len(plain)
            inside = "" if (at, after) == (0, len(plain)) else f" (bytes {at} to {after} of the unpacked member)"
            yield start, end, f"{e}{inside}", {}, b""
            at = after


def salvage(data: bytes) -> Iterator[Found]:
    """(start, end, reason, headers, block) of each record (reason None) and of each quarantined gap, in order, covering all bytes."""
    at, view = 0, memoryview(data)
    while at < len(data):
        try:
            if view[at : at + 2] == b"\x1f\x8b":
                plain, end = unpack(view, at)
                yield from _member(plain, at, end)  # an empty member pads
            else:
                headers, block, end = parse(data, at)
                yield at, end, None, headers, block
        except Damaged as e:
            end = _next_start(data, at + 1)
            yield at, end, str(e), {}, b""
        at = end


def payload(headers: dict[str, str], block: memoryview | bytes) -> memoryview | bytes:
    """The block without its HTTP head, where it has one."""
    head = re.search(rb"\r\n\r\n", block) if headers.get("content-type", "").startswith("application/http") else None
    return block[head.end() :] if head else block


# --- tables ----------------------------------------------------------------------------------------------------------


def typed(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with bytes, digest, record_type and refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumns({"bytes": F.octet_length(html).cast("long"), "digest": F.sha1(html.cast("binary"))})
    # Short payloads, empty ones above all, have no group to look up; their rows are spread by page.
    rows = rows.withColumn("_x", F.when(F.col("bytes") >= least, F.xxhash64(html)).otherwise(F.xxhash64("page_id", html)))
    keys = ["digest", "bytes", "_x"]
    groups = rows.where(F.col("bytes") >= least).groupBy(*keys).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    found = lookup(rows, shared_table(groups, "payloads"), keys, "n", pages.count(), [F.col("page_id")])
    nth = F.row_number().over(Window.partitionBy(*keys, "_deal", "page_id").orderBy("page_id"))
    response = F.col("n").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("_nth") == 1))
    found = found.withColumn("_nth", nth).withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    return found.withColumn("refers_to", F.when(~response, F.col("first_id"))).drop("_x", "_deal", "first_id", "n")


def _record_id(page: str | None, nth: int) -> str:
    return f"<urn:canopy:page:{'' if page is None else page}:{nth}>"


def records(typed_pages: DataFrame, packed: bool = True) -> Column:
    """Binary record of each row of a typed table, without its last byte."""

    @F.arrow_udf("binary")
    def made(page: pa.Array, nth: pa.Array, url: pa.Array, html: pa.Array, size: pa.Array, digest: pa.Array, kind: pa.Array, refers: pa.Array) -> pa.Array:
        out = []
        for p, n, u, h, b, d, k, r in zip(page.to_pylist(), nth.to_pylist(), url.to_pylist(), html, size.to_pylist(), digest.to_pylist(), kind.to_pylist(), refers.to_pylist()):
            headers = [("WARC-Type", k), ("WARC-Record-ID", _record_id(p, n)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{d}")]
            headers += [("WARC-Target-URI", u)] * (u is not None) + [("X-Page-Id", p)] * (p is not None) + [("X-Payload-Length", str(b))]
            if k == "revisit":
                headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(r, 1)), ("X-Refers-To-Page-Id", r or "")]
            headers.append(("Content-Type", "application/http;msgtype=response"))
            body = h.as_buffer().to_pybytes() if h.is_valid and k != "revisit" else b""
            plain = record(headers, HTTP + body)
            out.append((member(plain) if packed else plain)[:-1])
        return pa.array(out, pa.binary())

    text = lambda c: F.col(c).cast("string")
    return made(text("page_id"), F.col("_nth"), F.col("url"), F.col("html"), F.col("bytes"), F.col("digest"), F.col("record_type"), text("refers_to"))


def write_archive(pages: DataFrame, path: str, packed: bool = True, least: int = MIN_REVISIT) -> None:
    """Writes a record for each row of pages (page_id, url, html) to files below path."""
    rows = typed(pages.select("page_id", "url", "html"), least)
    bytes_as_text = rows.select(records(rows, packed).cast("string").alias("value"))
    bytes_as_text.write.option("lineSep", "\0" if packed else "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _read(batches, with_payload: bool):
    import posixpath

    names = ["file", "start", "end", "status", "reason", "headers", "payload_bytes", "payload_sha1"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for files in batches:
        for name, content in zip(files.column("path"), files.column("content")):
            rows, size = [], 0
            for start, end, reason, headers, block in salvage(content.as_buffer().to_pybytes()):
                body = payload(headers, block)
                row = [posixpath.basename(name.as_py()), start, end, "record" if reason is None else "quarantined", reason, list(headers.items())]
                row += [len(body), hashlib.sha1(body).hexdigest()] if reason is None else [None, None]
                rows.append([*row, bytes(body)] if with_payload else row)
                size += len(body) * with_payload + 500
                if size > 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives below path: file, start, end, status, reason, headers (names in lower case), payload_bytes, payload_sha1 and the payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda b: _read(b, with_payload), READ_SCHEMA + ", payload binary" * with_payload)


def quarantine_log(archive: DataFrame) -> DataFrame:
    """file, start, end, bytes and reason of the gaps of a read archive."""
    return archive.where("status = 'quarantined'").select("file", "start", "end", (F.col("end") - F.col("start")).alias("bytes"), "reason")


def pages_of(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of an archive that the writer made."""
    head = lambda name: F.col("headers")[name]
    full = head("warc-type") == "response"
    return archive.where("status = 'record'").select(
        head("x-page-id").cast(id_type).alias("page_id"),
        F.when(full, F.col("payload_bytes")).otherwise(head("x-payload-length").cast("long")).alias("payload_bytes"),
        F.when(full, F.col("payload_sha1")).otherwise(F.regexp_replace(head("warc-payload-digest"), "^sha1:", "")).alias("payload_digest"),
        head("warc-type").alias("record_type"),
        F.when(F.length(head("x-refers-to-page-id")) > 0, head("x-refers-to-page-id")).cast(id_type).alias("refers_to"),
    )
