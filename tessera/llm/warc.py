"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages, prepare, table, utf8

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes at which an archive is closed; a record is never split.
ARCHIVE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
_STEP = 1 << 16


class Record(NamedTuple):
    offset: int
    headers: dict
    block: bytes
    checked: bool = True  #: whether it was checked as a whole; of a damaged member only the block was

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page ``refers_to``, whose block has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '%20', url or '')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; its CRC and length are checked."""
    z, parts, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        if pos >= len(data):
            raise ValueError("truncated member")
        parts.append(z.decompress(data[pos : pos + _STEP]))
        pos = min(pos + _STEP, len(data))
    return b"".join(parts), pos - len(z.unused_data)


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``; the version line, length, terminator and block digest are checked."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of headers")
    headers = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("broken header")
        headers[name.lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("no terminator")
    block = bytes(data[start:stop])
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(block).hexdigest():
        raise ValueError("wrong block digest")
    return headers, block, stop + 4


def _partial(data: memoryview, at: int) -> bytes:
    """What decompresses of the damaged member at ``at``, up to the damage."""
    z, parts, pos = zlib.decompressobj(31), [], at
    while not z.eof and pos < len(data):
        before = z.copy()
        try:
            parts.append(z.decompress(data[pos : pos + _STEP]))
        except zlib.error:
            try:
                for i in range(pos, min(pos + _STEP, len(data))):
                    parts.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                pass
            break
        pos += _STEP
    return b"".join(parts)


def _sound(content: bytes, whole: bool) -> tuple[list[tuple[dict, bytes]], str]:
    """Records of a member's content, sought from version line to version line, and the first reason for one lost.

    Where the member isn't whole, only records with a block digest count, and not one that ends where the content does.
    """
    records, at, reason = [], 0, ""
    while 0 <= at < len(content):
        try:
            headers, block, end = _parse(content, at)
            if not whole and (end == len(content) or "warc-block-digest" not in headers):
                raise ValueError("unchecked record")
            records.append((headers, block))
            at = end
        except ValueError as e:
            reason = reason or str(e)[:80]
            at = content.find(b"WARC/1.", at + 1)
    return records, reason


#: What zlib says where a member is inflated to its end, but isn't what was stored.
_CHECK = re.compile("incorrect (data|length) check")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive (gzip members or plain), and the gaps between them.

    When a check fails, the reader goes on at the next member or version line from which a whole record can be read;
    the bytes passed over are one gap. Of a damaged member those records come back that inflate, parse and have their
    block's digest, unless the member's checksum fails though all of them do; their headers, which have no digest, may
    hold damage all the same, so they are marked as not ``checked``.
    """
    view, pos, lost, reason = memoryview(data), 0, None, ""
    while pos < len(data):
        damage, checked = "", True  # of a member some of whose records are lost
        try:
            if data.startswith(b"\x1f\x8b", pos):
                try:
                    content, end = _member(view, pos)
                    records, damage = _sound(content, True)
                except (ValueError, zlib.error) as e:
                    records, lost_one = _sound(_partial(view, pos), False)
                    damage, checked = str(e)[:80], False
                    if _CHECK.search(damage) and not lost_one:
                        records = []  # all blocks are sound, so the damage lies in some record's headers, which nothing checks
                    m = _START.search(data, pos + 1)
                    end = m.start() if m else len(data)
                if not records:
                    raise ValueError(damage or "empty member")
            else:
                headers, block, end = _parse(data, pos)
                records = [(headers, block)]
        except (ValueError, zlib.error) as e:
            if lost is None:
                lost, reason = pos, str(e)[:80]
            m = _START.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        if lost is not None:
            yield Gap(lost, pos, reason)
            lost = None
        for headers, block in records:
            yield Record(pos, headers, block, checked)
        if damage:
            lost, reason = pos, damage
        pos = end
    if lost is not None:
        yield Gap(lost, len(data), reason)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k, size = TaskContext.get().partitionId(), 0, 0
    members: list[bytes] = []

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{k:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], ["path", "content"])

    for b in batches:
        for row in b.to_pylist():
            members.append(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
            size += len(members[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                members, size, k = [], 0, k + 1
    if members:
        yield archive()


def write_archives(frame: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Archives (path, content), with the columns of Spark's binaryFile reader, of one record for each page.

    Of equal payloads of at least ``least`` bytes the page with the largest id is a response, and the others revisit
    it. Groups are found by digests alone: counts and largest ids are summed map-side first, and only pages that
    revisit another are matched, so a hot payload moves one row a page and no html. Null html is empty; a page without
    an id is always a response; repeated rows of the chosen page all are responses; an empty table gives no archive;
    other columns are ignored.
    """
    prepare(frame.sparkSession)
    payload = utf8(html)
    base = frame.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    narrow = base.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha2("payload", 256).alias("key"))
    groups = narrow.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    revisits = narrow.distinct().join(groups, "key").where("page_id < refers_to").withColumnRenamed("page_id", "id")
    revisits = revisits.withColumnRenamed("key", "same")
    # pages without an id match nothing; the url deals them over all tasks, however alike they are
    whole = base.withColumn("key", F.sha2("payload", 256)).withColumn("spread", F.when(F.col("page_id").isNull(), F.xxhash64("url")).otherwise(0))
    same = (F.col("page_id") == F.col("id")) & (F.col("key") == F.col("same")) & (F.col("spread") == F.col("zero"))
    whole = whole.join(revisits.withColumn("zero", F.lit(0).cast("long")), same, "left")
    rows = whole.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "refers_to")
    return rows.mapInArrow(_write, "path string, content binary")


FOUND = "page_id long, record_type string, refers_to long, digest string, payload_bytes long, payload_digest string, path string, offset long, end long, reason string, checked boolean"
_FOUND = ["page_id", "record_type", "refers_to", "digest", "payload_bytes", "payload_digest", "path", "offset", "end", "reason", "checked"]


def _salvage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    for b in batches:
        for row in b.to_pylist():
            out = []
            for x in read_archive(row["content"] or b""):
                if isinstance(x, Gap):
                    out.append((None, "gap", None, None, None, None, row["path"], x.start, x.end, x.reason, None))
                    continue
                h, stored = x.headers, x.headers.get("warc-type") != "revisit"
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                own = hashlib.sha1(x.payload).hexdigest() if stored else None
                out.append((number(h.get("warc-record-id")), h.get("warc-type"), number(h.get("warc-refers-to")), digest, len(x.payload) if stored else None, own, row["path"], x.offset, None, None, x.checked))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], _FOUND)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record and each quarantined gap (record_type ``gap``, offset, end, reason) of (path, content). ``checked``: see ``read_archive``.

    A revisit's payload is that of the record it refers to: bytes and digest come from there, and stay null if it is lost.
    """
    prepare(archives.sparkSession)
    found = archives.select("path", "content").mapInArrow(_salvage, FOUND)
    found = table(found, "warc-records")
    originals = found.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest")).agg(F.max("payload_bytes").alias("o_bytes"))
    both = found.join(originals, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("o_id")) & (F.col("digest") == F.col("o_digest")), "left")
    return both.select(
        "page_id", "record_type", "refers_to", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "o_digest").alias("payload_digest"), "path", "offset", "end", "reason", "checked"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = table(write_archives(pages(spark, sf_dir)), "warc")
    return read_archives(archives).where("record_type != 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
q AS (SELECT *, strlen(t) >= 1000 AND page_id < top AS again FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM q
"""
