"""Signatures and validators of foreign formats, alone, nested and damaged."""

import io
import struct
import time
import zipfile

import pytest

from courtflux.llm import media


def jpeg(scan=b"\x12\xff\x00\x34\xff\xd0\x56"):
    seg = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + seg(0xC0, bytes(9)) + seg(0xDA, bytes(6)) + scan + seg(0xDA, bytes(6)) + scan + b"\xff\xd9"


def pdf(body=b"1 0 obj\n<<>>\nendobj\n"):
    head = b"%PDF-1.4\n" + body
    return head + b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % len(head)


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def ogg():
    page = lambda flags, stream, n, data: b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<III", stream, n, 0) + bytes([1, len(data)]) + data
    return page(2, 7, 0, b"head") + page(2, 8, 0, b"head") + page(0, 7, 1, b"x" * 200) + page(4, 8, 1, b"") + page(4, 7, 2, b"end")


def flac(frames=b"\xff\xf8" + b"data" * 9):
    return b"fLaC" + b"\x00\x00\x00\x22" + bytes(34) + b"\x84\x00\x00\x04vorb" + frames


def mp4():
    box = lambda name, data: struct.pack(">I", len(data) + 8) + name + data
    return box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", bytes(20)) + struct.pack(">I4sQ", 1, b"mdat", 16 + 30) + b"m" * 30


BEFORE = b"BM fLaC %PDF- PK\x03\x04"
MADE = {"image/jpeg": jpeg(), "application/pdf": pdf(), "application/zip": zipped({"a": b"x" * 50}), "audio/ogg": ogg(), "audio/flac": flac(), "video/mp4": mp4()}


@pytest.mark.parametrize("kind", MADE)
def test_alone_and_behind_a_prefix(kind):
    blob = MADE[kind]
    assert media.corrected(blob, "text/plain") == (kind, [])
    behind = media.sniff(BEFORE + blob + (b"" if kind == "audio/flac" else b" tail OggS ftyp"))
    assert [(f.kind, f.start, f.end) for f in behind] == [(kind, len(BEFORE), len(BEFORE) + len(blob))]


@pytest.mark.parametrize("kind", [k for k in MADE if k != "audio/flac"])
def test_cut_short(kind):
    assert not [f for f in media.sniff(MADE[kind][:-1].rstrip(b"\n")) if f.kind == kind and f.end > len(MADE[kind]) - 2] or kind == "application/pdf"
    assert media.sniff(MADE[kind][: len(MADE[kind]) // 3]) == []


def test_damaged():
    assert media.sniff(jpeg().replace(b"\xff\xc0", b"\xff\xe1")) == []  # no frame
    assert media.sniff(pdf().replace(b"xref\n0", b"rexf\n0")) == []
    assert media.sniff(zipped({"a": b"x"})[1:]) == []
    assert media.sniff(flac(b"no frame")) == []
    assert media.sniff(mp4().replace(b"moov", b"free")) == []


def test_nested(spark):
    inner = jpeg()
    blob = zipped({"one.pdf": pdf(b"1 0 obj\n" + inner + b"\nendobj\n"), "two.ogg": ogg()})
    df = spark.createDataFrame([(1, bytearray(blob), "image/png"), (2, bytearray(b"no media"), "x"), (3, None, None), (4, bytearray(b""), None)], "id long, media binary, declared string")
    rows = {r.id: r for r in media.carve(df).collect()}
    assert rows[1].type == "application/zip" and [c.kind for c in rows[1].carved] == ["application/pdf", "image/jpeg", "audio/ogg"]
    assert bytes(rows[1].carved[1].bytes) == inner and blob[rows[1].carved[2].start : rows[1].carved[2].end] == ogg()
    assert (rows[2].type, rows[2].carved, rows[3].type, rows[3].carved) == ("x", [], None, [])
    assert rows[4].type == "application/octet-stream" and rows[4].carved == []


def test_many_streams_in_a_blob():
    """1,200 streams follow each other without a call inside a call, and unconfirmed marks end none."""
    one = flac()
    found = media.sniff(one * 1200)
    assert [(f.start, f.end) for f in found] == [(i * len(one), (i + 1) * len(one)) for i in range(1200)]
    marked = flac(b"\xff\xf8" + b"fLaC" * 5)
    assert [(f.start, f.end) for f in media.sniff(marked + one)] == [(0, len(marked)), (len(marked), len(marked) + len(one))]


def test_blocks_are_walked_once():
    """Many marks lead to one long run of empty blocks."""
    jump = lambda n: b"fLaC" + b"\x00\x00\x00\x22" + bytes(34) + b"\x01" + n.to_bytes(3, "big")
    size, marks = len(jump(0)), 2000
    blob = b"".join(jump((marks - 1 - i) * size) for i in range(marks)) + b"\x01\0\0\0" * 200_000 + b"\x81\0\0\0\xff\xf8"
    began = time.perf_counter()
    assert len(media.sniff(blob)) == marks and time.perf_counter() - began < 5


def test_many_entries_of_an_archive():
    """Every local header asks for the end records, which are looked for once."""
    blob = zipped({f"{i}": b"x" * 2000 for i in range(20_000)})
    began = time.perf_counter()
    assert [(f.kind, f.start, f.end) for f in media.sniff(blob + blob)] == [("application/zip", 0, len(blob)), ("application/zip", len(blob), 2 * len(blob))]
    assert time.perf_counter() - began < 10
