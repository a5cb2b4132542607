"""MPEG audio: round trips with marks at every offset, tags, tables, free format and checksums of all layers."""

import random
import struct

import pytest

from tessera.llm import mpeg_audio as M


@pytest.mark.parametrize("mark", [b"TAG", b"ID3\4\0\0\0\0\0\7", b"Xing", b"Info", b"VBRI", M.HEADER, b"\xff\xfb\x90\x00", b"RIFF"])
def test_marks_in_the_payload(mark):
    for n in (576, 570, 4 * 576):
        for at in range(max(0, n - 576), n - len(mark) + 1):
            data = bytearray(b"a" * n)
            data[at : at + len(mark)] = mark
            s = M.decode(M.encode(bytes(data)))
            assert s.payload == bytes(data) + b"\xff" * (-n % 576) and s.bad == 0 and not s.gaps and s.table["agrees"], (n, at)


def test_random_payloads():
    rng = random.Random(3)
    for _ in range(200):
        data = rng.choices([rng.randbytes, lambda n: bytes(rng.choice([255, 242, 216, 192, 84, 65, 71]) for _ in range(n))])[0](rng.randrange(0, 3000))
        assert M.decode(M.encode(data)).payload == data + b"\xff" * (-len(data) % 576 or (0 if data else 576))


def test_tags():
    stream = M.encode(b"x" * 600)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"One".ljust(30, b" ") + b"Disc".ljust(30, b"\0") + b"1999" + bytes(31)
    s = M.decode(stream + v1)
    assert len(v1) == 128 and (s.tags["title"], s.tags["artist"], s.tags["album"], s.tags["year"]) == ("Song", "One", "Disc", "1999") and not s.gaps and len(s.payload) == 1152
    assert M.decode(stream + b"junk" + v1).gaps == [(len(stream), len(stream) + 4)]
    frames = stream[M._id3v2(stream, 0)[0] :]
    body = b"TIT2" + struct.pack(">I", 6) + b"\0\0" + b"\0a\xffb\xffc"
    extended = struct.pack(">IHI", 6, 0, 0)
    whole = (extended + body).replace(b"\xff", b"\xff\0")
    tag = b"ID3\3\0\xc0" + M._synchsafe(len(whole)) + whole
    assert M.decode(tag + frames).tags == {"TIT2": "aÿbÿc"} and M.decode(tag + frames).payload == s.payload
    assert M._id3v2(b"ID3\2\0\0" + M._synchsafe(10) + b"TT2\0\0\4\0abc", 0) == (20, {"TT2": "abc"})
    assert M._id3v2(b"ID3\4\0\x10" + M._synchsafe(0) + b"3DI" + bytes(7), 0)[0] == 20


def test_tables_are_held_against_the_frames():
    stream = M.encode(b"x" * 3000)
    assert M.decode(stream).table["agrees"] and M.decode(stream[:-M.FRAME]).table["agrees"] is False
    at = M._id3v2(stream, 0)[0]
    vbri = bytearray(stream)
    vbri[at + 15 : at + M.FRAME] = bytes(M.FRAME - 15)
    frame = M.HEADER + bytes(vbri[at + 4 : at + 36]) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, len(stream) - at, 6, 3, 2, 2, 2) + struct.pack(">HHH", 648, 648, 324)
    vbri[at : at + len(frame)] = frame
    got = M.decode(bytes(vbri))
    assert got.table == {"kind": "VBRI", "bytes": len(stream) - at, "frames": 6, "frames_per_entry": 2, "toc": [1296, 1296, 648], "agrees": True} and len(got.offsets) == 6


@pytest.mark.parametrize("word", [b"\xff\xfe\x94\xc0", b"\xff\xfe\x94\x40", b"\xff\xfc\x94\x00", b"\xff\xfc\x94\x40", b"\xff\xfc\x24\xc0", b"\xff\xf4\x84\x00", b"\xff\xfa\x94\x40", b"\xff\xf2\x84\xc0"])
def test_checksums_of_all_layers(word):
    """A frame whose checksum is right passes, and each bit that it covers counts."""
    rng = random.Random(word)
    h = M.header(word)
    frame = bytearray(word + b"\0\0" + rng.randbytes(h.length - 6))
    for i in range(6, len(frame)):  # no sync inside
        frame[i] &= 0x7F
    bits = M.checked_bits(bytes(frame), 6, h)
    frame[4:6] = M.crc16(bytes(frame[2:4] + frame[6 : 6 + (bits + 7) // 8]), 16 + bits).to_bytes(2, "big")
    assert h.checked and M.decode(bytes(frame) * 3).bad == 0 and len(M.decode(bytes(frame) * 3).offsets) == 3
    broken = bytearray(frame * 3)
    broken[len(frame) + 6] ^= 0x10
    assert M.decode(bytes(broken)).bad == 1
    after = 6 + (bits + 7) // 8 + 1  # beyond what the checksum covers
    broken = bytearray(frame * 3)
    broken[len(frame) + after] ^= 0x10
    assert M.decode(bytes(broken)).bad == 0


def test_allocations_of_layer_two():
    for word, bands, bits in ((b"\xff\xfc\xa0\xc0", 30, 4 * 11 + 3 * 12 + 2 * 7), (b"\xff\xfc\x54\xc0", 27, 4 * 11 + 3 * 12 + 2 * 4), (b"\xff\xfc\x10\xc0", 8, 8 + 18), (b"\xff\xfc\x18\xc0", 12, 8 + 30), (b"\xff\xf4\x80\xc0", 30, 16 + 21 + 38)):
        h = M.header(word)
        assert M.checked_bits(bytes(100), 0, h) == bits and M.checked_bits(b"\xff" * 100, 0, h) == bits + 2 * bands


def test_free_format():
    word = b"\xff\xfb\x00\xc0"
    frame = word + bytes(496)
    padded = b"\xff\xfb\x02\xc0" + bytes(497)
    s = M.decode(frame + padded + frame + frame)
    assert s.offsets == [0, 500, 1001, 1501] and not s.gaps and s.header.bitrate == 0 and s.samples == 4 * 1152
    assert M.decode(word + bytes(100)).offsets == []
