"""MPEG audio columns: frames that carry a payload, and a reader that resynchronises, checks and indexes any stream."""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare, table, utf8

# Fixed values of the MPEG audio format: kbit/s by (version 1 or 2, layer), index 1 to 14, and sampling rates by version.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {3: 1.0, 2: 2.0, 0: 2.5}
# Fixed values of layer II: bits of the allocation of each subband, by number of subbands ("low": MPEG-2 rates).
ALLOCATION = {27: (4,) * 11 + (3,) * 12 + (2,) * 4, 30: (4,) * 11 + (3,) * 12 + (2,) * 7, 8: (4,) * 2 + (3,) * 6, 12: (4,) * 2 + (3,) * 10, "low": (4,) * 4 + (3,) * 7 + (2,) * 19}

#: The stored form: MPEG-2 layer III, mono, 144 kbit/s at 16 kHz with a checksum. A frame has UNIT samples, and its main
#: data begin with UNIT payload bytes.
UNIT, FILL, HEADER, FRAME, BODY = 576, 255, bytes((0xFF, 0xF2, 0xD8, 0xC0)), 648, 15
#: Bytes of the tag at a stream's end, and bytes within which a free-format frame ends.
ID3V1, FREE_MOST = 128, 8192


class Header(NamedTuple):
    version: float
    layer: int
    checked: bool
    bitrate: int  #: kbit/s; 0: free format
    rate: int
    length: int  #: bytes; in free format only those of the padding
    samples: int
    side: int  #: bytes of side information (layer III)
    mode: int
    extension: int

    @property
    def kind(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate, self.bitrate == 0


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or bitrate == 15 or rate == 3 or word[3] & 3 == 2:
        return None
    major = 1 if version == 1.0 else 2
    kbps, hz, pad, mono = (0, *BITRATES[major, layer])[bitrate], RATES[version][rate], word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or major == 1 else 576
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if major == 1 else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, kbps, hz, length, samples, side, word[3] >> 6, word[3] >> 4 & 3)


@lru_cache(65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of MPEG audio over the first ``bits``: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for i in range(len(data) * 8 if bits is None else bits):
        out = crc >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if out else 0)) & 0xFFFF
    return crc


def checked_bits(data: bytes, body: int, h: Header) -> int:
    """How many bits after the checksum it covers: the side information, or the allocations (with the scale factor
    selectors of layer II)."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mode == 3 else 2
    joint = 4 * (h.extension + 1) if h.mode == 1 else 32
    if h.layer == 1:
        return 4 * (joint * channels + 32 - joint)
    each = h.bitrate // channels
    few = 8 if h.rate != 32000 else 12
    bits = ALLOCATION["low" if h.version != 1.0 else few if h.bitrate and each <= 48 else 30 if (not h.bitrate or each >= 96) and h.rate != 48000 else 27]
    at = used = 0
    for band, n in enumerate(bits):
        for _ in range(channels if band < joint else 1):
            word = int.from_bytes(data[body + (at >> 3) : body + (at >> 3) + 2].ljust(2, b"\0"), "big")
            given = word >> (16 - n - (at & 7)) & ((1 << n) - 1)
            used += (given > 0) * (1 if band < joint else channels)
            at += n
    return at + 2 * used


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsafe(raw: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=False))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\3" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body


def encode(data: bytes) -> bytes:
    """A stream of an ID3v2 tag (the payload's bytes), an Info frame with its seek table, and the payload's frames."""
    payload = data + bytes([FILL]) * (-len(data) % UNIT or (0 if data else UNIT))
    n = len(payload) // UNIT
    side = bytes(9)
    start = HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :BODY] = np.frombuffer(start, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(i * 256 // 100 for i in range(100))
    info = (start + b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc).ljust(FRAME, b"\0")
    tag = _text_frame("payload_bytes", str(len(data)))
    return b"ID3\4\0\0" + _synchsafe(len(tag)) + tag + info + frames.tobytes()


class Stream(NamedTuple):
    tags: dict
    table: dict  #: of a Xing, Info or VBRI frame: kind, frames, bytes, toc, and whether frames and bytes are those found
    offsets: list  #: byte offset of each audio frame
    samples: int
    duration: Fraction  #: seconds
    bad: int  #: frames whose checksum is wrong
    gaps: list  #: (start, end) of bytes outside frames and tags
    header: Header | None
    payload: bytes


def _id3v2(data: bytes, at: int) -> tuple[int, dict]:
    """End and text frames of the tag at ``at`` (versions 2.2 to 2.4, with extended headers and unsynchronisation)."""
    version, flags, size = data[at + 3], data[at + 5], _unsafe(data[at + 6 : at + 10])
    end, body, tags, pos = at + 10 + size + 10 * (version == 4 and flags >> 4 & 1), data[at + 10 : at + 10 + size], {}, 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2:
        pos = _unsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while pos + head <= len(body) and body[pos]:
        raw = body[pos + name : pos + 2 * name]
        n = _unsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        content, kind = body[pos + head : pos + head + n], body[pos : pos + name].decode("latin-1")
        if version == 4:
            form = body[pos + 9]
            content = content[4:] if form & 1 else content
            content = content.replace(b"\xff\0", b"\xff") if form & 2 else content
        if content and content[0] < 4 and kind.startswith("T"):
            key, _, value = content[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[content[0]], "replace").partition("\0")
            tags |= {key: value.lstrip("﻿").rstrip("\0")} if kind in ("TXXX", "TXX") else {kind: key}
        pos += head + n
    return min(end, len(data)), tags


def _id3v1(tag: bytes) -> dict:
    field = lambda a, b: tag[a:b].split(b"\0")[0].rstrip(b" ").decode("latin-1")
    return {"title": field(3, 33), "artist": field(33, 63), "album": field(63, 93), "year": field(93, 97)}


def _vbr_table(data: bytes, at: int, h: Header) -> dict:
    body = at + 4 + 2 * h.checked + h.side
    kind = data[body : body + 4]
    if kind in (b"Xing", b"Info"):
        flags, pos, out = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[pos : pos + 4], "big")
                pos += 4
        if flags & 4:
            out["toc"] = list(data[pos : pos + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        _, _, _, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", data[at + 40 : at + 62].ljust(22, b"\0"))
        raw = data[at + 62 : at + 62 + entries * width]
        toc = [scale * int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "bytes": size, "frames": frames, "frames_per_entry": each, "toc": toc}
    return {}


def _free_length(data: bytes, pos: int, h: Header, end: int) -> int:
    """Bytes, without padding, of the free-format frame at ``pos``: up to the next header of its kind that a further
    header at the same distance, or the end, confirms. 0: none."""
    at = data.find(b"\xff", pos + 4 + h.side, pos + FREE_MOST)
    while at >= 0:
        base, nxt = at - pos - h.length, header(data[at : at + 4])
        if nxt and nxt.kind == h.kind:
            after = at + base + nxt.length
            further = header(data[after : after + 4])
            if after == end or further and further.kind == h.kind:
                return base
        at = data.find(b"\xff", at + 1, pos + FREE_MOST)
    return 0


def decode(data: bytes, take: int = UNIT) -> Stream:
    """Reads a whole stream. After a broken header it searches the next header that a second one (or the end) confirms.

    Tags are taken only where no frame covers them: ID3v2 before the first frame, ID3v1 in the last bytes when the walk
    over frames has come to them.
    """
    tags: dict = {}
    found: dict = {}
    offsets: list[int] = []
    gaps: list[tuple[int, int]] = []
    pieces: list[bytes] = []
    samples = bad = pos = free = 0
    first = None
    if data[:3] == b"ID3" and len(data) >= 10:
        pos, tags = _id3v2(data, 0)
    begin, end = pos, len(data)
    tag = end - ID3V1 if end - pos >= ID3V1 and data.startswith(b"TAG", end - ID3V1) else -1
    synced = False
    runs: dict[tuple[int, int], int] = {}
    while pos < end:
        if pos == tag:
            tags |= _id3v1(data[tag:])
            break
        h = header(data[pos : pos + 4])
        if h and first and h.kind != first.kind:
            h = None
        length = h.length if h else 0
        if h and not h.bitrate:
            free = free or _free_length(data, pos, h, end)
            length = free + length if free else 0
        after = pos + length
        if h and (not length or after > end or not synced and after not in (end, tag) and not header(data[after : after + 4])):
            h = None
        if not h:
            nxt = data.find(b"\xff", pos + 1, end)
            nxt = end if nxt < 0 else nxt
            if pos < tag < nxt:
                nxt = tag
            if gaps and gaps[-1][1] == pos:
                gaps[-1] = (gaps[-1][0], nxt)
            else:
                gaps.append((pos, nxt))
            pos, synced = nxt, False
            continue
        synced = True
        body = pos + 4 + 2 * h.checked + h.side
        if first is None:
            first = h
            if h.layer == 3 and (found := _vbr_table(data, pos, h)):
                pos = after
                continue
        if h.checked:
            bits = checked_bits(data, pos + 6, h)
            bad += crc16(data[pos + 2 : pos + 4] + data[pos + 6 : pos + 6 + (bits + 7) // 8], 16 + bits) != int.from_bytes(data[pos + 4 : pos + 6], "big")
        offsets.append(pos)
        pieces.append(data[body : min(body + take, after)])
        samples += h.samples
        runs[h.samples, h.rate] = runs.get((h.samples, h.rate), 0) + 1
        pos = after
    if found:
        found["agrees"] = found.get("frames", len(offsets)) == len(offsets) and found.get("bytes", pos - begin) == pos - begin
    seconds = sum((Fraction(s * n, rate) for (s, rate), n in runs.items()), Fraction(0))
    return Stream(tags, found, offsets, samples, seconds, bad, gaps, first, b"".join(pieces))


def _encode(payloads: pa.Array) -> pa.Array:
    return pa.array([encode(x or b"") for x in payloads.to_pylist()], pa.binary())


READ = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,n_frames:long,duration:double,seek_offsets:array<int>,bad_frames:long,gap_bytes:long>"
_READ = pa.struct([
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("feature", pa.string()), ("n_frames", pa.int64()), ("duration", pa.float64()), ("seek_offsets", pa.list_(pa.int32())), ("bad_frames", pa.int64()), ("gap_bytes", pa.int64()),
])


def _feature(s: Stream) -> str:
    if not (h := s.header):
        return "none"
    vbr = f"{s.table['kind']}:{s.table.get('frames', '')}:{'agrees' if s.table['agrees'] else 'differs'}" if s.table else ""
    return f"mpeg{h.version:g}-layer{h.layer};rate={h.rate};frames={len(s.offsets)};duration={s.duration};table={vbr};bad={s.bad};gaps={len(s.gaps)}"


def _read(media: pa.Array) -> pa.Array:
    out = []
    for raw in media.to_pylist():
        if raw is None:
            out.append(None)
            continue
        s = decode(raw)
        size = s.tags.get("payload_bytes", "")
        out.append({
            "n_bytes": int(size) if size.isdigit() else None, "payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest(), "tail_crc32": zlib.crc32(s.payload[-32:]),
            "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest(), "feature": _feature(s), "n_frames": len(s.offsets), "duration": float(s.duration),
            "seek_offsets": s.offsets, "bad_frames": s.bad, "gap_bytes": sum(b - a for a, b in s.gaps),
        })
    return pa.array(out, _READ)


def store(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Puts an audio stream that carries each whole text in the place of the text.

    Null texts count as empty (one frame of fill); equal texts give equal streams; other columns, null ids and
    repeated rows pass through (a column named ``to`` is replaced); an empty table stays empty.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(to, F.arrow_udf(_encode, "binary")(utf8(text))).drop(text)


def index(media: DataFrame, column: str = "media", to: str = "audio") -> DataFrame:
    """Reads each stream of a binary column: sizes, digests, exact duration, seek offsets, bad frames, gaps. Null stays
    null; a stream without a frame has no payload and the feature ``none``; a column named ``to`` is replaced."""
    prepare(media.sparkSession)
    return media.withColumn(to, F.arrow_udf(_read, READ)(column))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(store(documents(spark, sf_dir).select("doc_id", "text")), "media")
    return index(stored).select("doc_id", *[f"audio.{c}" for c in _READ.names])


def _hex(value: str, digits: int) -> str:
    return f"lpad(to_hex({value}), {digits}, '0')"


def _sql() -> str:
    """The same in DuckDB's SQL: streams as hexadecimal text, and CRC-32 from a table made by its rule."""
    start = (HEADER + crc16(HEADER[2:] + bytes(9)).to_bytes(2, "big") + bytes(9)).hex().upper()
    toc = bytes(i * 256 // 100 for i in range(100)).hex().upper()
    name = b"\3payload_bytes\0".hex().upper()
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
u AS (SELECT *, greatest(1, (n + {UNIT - 1}) // {UNIT}) AS k FROM d),
p AS (SELECT *, h || repeat('{FILL:02X}', k * {UNIT} - n) AS body, hex(encode(n::VARCHAR)) AS digits FROM u),
m AS (SELECT *, octet_length(unhex(digits)) + {len(name) // 2} AS inner_bytes FROM p),
f AS (SELECT *, hex(encode('ID3')) || '040000' || {_hex('inner_bytes + 10', 8)} || hex(encode('TXXX')) || {_hex('inner_bytes', 8)} || '0000{name}' || digits
      || '{start}' || hex(encode('Info')) || '00000007' || {_hex('k', 8)} || {_hex(f'(k + 1) * {FRAME}', 8)} || '{toc}' || repeat('00', {FRAME - BODY - 116})
      || array_to_string(list_transform(range(k), lambda i: '{start}' || substr(body, i * {2 * UNIT} + 1, {2 * UNIT}) || repeat('00', {FRAME - BODY - UNIT})), '') AS media FROM m),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)
SELECT doc_id, n AS n_bytes, k * {UNIT} AS payload_bytes, sha256(unhex(body)) AS payload_sha256,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(32), lambda i: ('0x' || substr(body, 2 * (k * {UNIT} - 32 + i) + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS tail_crc32,
  (length(media) // 2)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'mpeg2-layer3;rate=16000;frames=' || k || ';duration=' || (9 * k // gcd(9 * k, 250)) || CASE WHEN gcd(9 * k, 250) = 250 THEN '' ELSE '/' || (250 // gcd(9 * k, 250)) END || ';table=Info:' || k || ':agrees;bad=0;gaps=0' AS feature,
  k AS n_frames, 9 * k / 250::DOUBLE AS duration, list_transform(range(1, k + 1), lambda i: (i * {FRAME} + inner_bytes + 20)::INT) AS seek_offsets, 0::BIGINT AS bad_frames, 0::BIGINT AS gap_bytes
FROM f, t
"""


OP4_SQL = _sql()
