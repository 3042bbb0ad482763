"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton locates magic bytes in a blob. For each place the format's validator confirms structure and lengths; the first
confirmed format at offset 0 is the blob's type and corrects a wrong declared one, confirmed formats further in are embedded media that
``carve`` gives as rows' arrays, for any binary column. Formats: WAV, BMP, AU, PNG, GIF, JPEG, PDF, ZIP, Ogg, FLAC and ISO media (MP4).
Payloads are stored losslessly as 8-bit samples in one of three containers, chosen by the payload's checksum, so equal payloads are stored
equally: WAV (mono), BMP (grey, 576 wide) and AU (linear 8 bit).

Defined results: null and empty payloads are one padded unit. A blob without a confirmed format at offset 0 (unknown, truncated, or media
behind a prefix) keeps its declared type, else it is application/octet-stream; its payload is the whole blob. A null blob has a null type,
payload, digests and feature, and no carved media. Bytes that only look like a signature are passed over. Places that lie
inside a confirmed format's bytes are carved too if they are confirmed; of places at one offset the first in order of FORMATS counts.
Formats whose streams don't tell their length (FLAC) end where the blob or the next confirmed FLAC does. Repeated rows get equal results,
an empty table gives an empty one, blobs of any length are read whole. ``carve`` passes all columns on and fails if one is named type,
payload or carved already.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import cache
from typing import NamedTuple, TypeVar

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType, _parse_datatype_string

from ..runtime import ship
from . import common as C

T = TypeVar("T")
UNIT = 576  # samples in a row of a stored picture


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    payload_start: int
    payload_end: int


# -- containers ----------------------------------------------------------------------------------------------------------------


def to_wav(x: bytes) -> bytes:
    pad = len(x) & 1
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8)
    return b"RIFF" + struct.pack("<I", len(head) + 8 + len(x) + pad) + head + b"data" + struct.pack("<I", len(x)) + x + b"\0" * pad


_GREY = b"".join(bytes((i, i, i, 0)) for i in range(256))


def to_bmp(x: bytes) -> bytes:
    """Rows from the top (negative height), so that the samples lie in the payload's order."""
    head = struct.pack("<IiiHHIIiiII", 40, UNIT, -(len(x) // UNIT), 1, 8, 0, len(x), 2835, 2835, 256, 0)
    at = 14 + len(head) + len(_GREY)
    return b"BM" + struct.pack("<IHHI", at + len(x), 0, 0, at) + head + _GREY + x


def to_au(x: bytes) -> bytes:
    return b".snd" + struct.pack(">IIIII", 28, len(x), 2, 8000, 1) + b"\0\0\0\0" + x


# -- validators: at the place of a signature, the format's extent, or None -----------------------------------------------------


def of_blob(f: Callable[[bytes], T]) -> Callable[[bytes], T]:
    """``f`` once for a blob, however many places ask: what it gave last is kept with its blob."""
    last: list[tuple[bytes, T]] = []

    def kept(b: bytes) -> T:
        if not last or last[0][0] is not b:
            last[:] = [(b, f(b))]
        return last[0][1]

    return kept


def _wav(b: bytes, at: int) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end, at_chunk, fmt = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, False
    while at_chunk + 8 <= min(end, len(b)):
        name, size = b[at_chunk : at_chunk + 4], struct.unpack_from("<I", b, at_chunk + 4)[0]
        if at_chunk + 8 + size > min(end, len(b)):
            return None
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HH", b, at_chunk + 8)[0] == 1
        if name == b"data" and fmt:
            return Found("audio/wav", at, end, at_chunk + 8, at_chunk + 8 + size) if end <= len(b) else None
        at_chunk += 8 + size + (size & 1)
    return None


def _bmp(b: bytes, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    size, _, _, off = struct.unpack_from("<IHHI", b, at + 2)
    head, width, height, planes, bits, packed = struct.unpack_from("<IiiHHI", b, at + 14)
    if head != 40 or planes != 1 or bits not in (1, 4, 8, 24, 32) or packed or width <= 0 or not height or at + size > len(b):
        return None
    if size - off != (width * bits + 31) // 32 * 4 * abs(height):
        return None
    return Found("image/bmp", at, at + size, at + off, at + size)


def _au(b: bytes, at: int) -> Found | None:
    if at + 24 > len(b):
        return None
    off, size, encoding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if off < 24 or not 1 <= encoding <= 27 or not rate or not 1 <= channels <= 64 or at + off + size > len(b):
        return None
    return Found("audio/basic", at, at + off + size, at + off, at + off + size)


def _png(b: bytes, at: int) -> Found | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or (name == b"IHDR") != first:
            return None
        if zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        p, first = p + 12 + size, False
        if name == b"IEND":
            return Found("image/png", at, p, at, p)
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return Found("image/gif", at, p + 1, at, p + 1)
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    """Segments by their lengths, then coded data up to a marker that is neither stuffing nor a restart, until the end marker."""
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:  # fill
            p += 1
            continue
        if kind == 0xD9:
            return Found("image/jpeg", at, p + 2, at, p + 2) if frame else None
        if kind < 0xC0 or 0xD0 <= kind <= 0xD8:
            return None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or p + 2 + size > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:
            if not frame:
                return None
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return Found("image/jpeg", at, p + 2, at, p + 2) if frame and b[p : p + 2] == b"\xff\xd9" else None


_END_OF_PDF = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF(\r\n|\r|\n)?")


def _pdf(b: bytes, at: int) -> Found | None:
    """Up to the last end mark, before the next document, whose cross-reference offset leads to a table or an object."""
    nxt = b.find(b"%PDF-", at + 5)
    end = None
    for m in _END_OF_PDF.finditer(b, at, nxt if nxt >= 0 else len(b)):
        to = at + int(m.group(1))
        if to < m.start() and (b.startswith(b"xref", to) or b[to : to + 1].isdigit()):
            end = m.end()
    return None if end is None else Found("application/pdf", at, end, at, end)


def _zip(b: bytes, at: int) -> Found | None:
    """From the first local header to the end record whose directory lies where its offsets, counted from here, say."""
    end = _zip_ends(b).get(at)
    return None if end is None else Found("application/zip", at, end, at, end)


@of_blob
def _zip_ends(b: bytes) -> dict[int, int]:
    """Where archives begin, by their end records, and end; of several end records of one beginning the first counts."""
    found: dict[int, int] = {}
    p = b.find(b"PK\x05\x06")
    while 0 <= p <= len(b) - 22:
        count, size, offset, comment = struct.unpack_from("<HIIH", b, p + 10)
        at = p - size - offset
        if at >= 0 and p + 22 + comment <= len(b) and (not count or b.startswith(b"PK\x01\x02", p - size)):
            found.setdefault(at, p + 22 + comment)
        p = b.find(b"PK\x05\x06", p + 1)
    return found


def _ogg(b: bytes, at: int) -> Found | None:
    """Pages in sequence from one that begins streams, until all that began have ended."""
    p, open_streams, number = at, set(), {}
    while p + 27 <= len(b) and b.startswith(b"OggS\0", p):
        flags, stream, sequence, segments = b[p + 5], *struct.unpack_from("<II", b, p + 14), b[p + 26]
        stop = p + 27 + segments + sum(b[p + 27 : p + 27 + segments])
        if p + 27 + segments > len(b) or stop > len(b) or (p == at and not flags & 2):
            return None
        if flags & 2:
            if stream in number:
                return None
            open_streams.add(stream)
        elif stream not in open_streams or sequence != number[stream] + 1:
            return None
        number[stream] = sequence
        p = stop
        if flags & 4:
            open_streams.discard(stream)
            if not open_streams:
                return Found("audio/ogg", at, p, at, p)
    return None


def _flac(b: bytes, at: int) -> Found | None:
    """A confirmed stream up to the next confirmed one, or the blob's end."""
    starts = _flac_starts(b)
    k = bisect_left(starts, at)
    if k == len(starts) or starts[k] != at:
        return None
    end = starts[k + 1] if k + 1 < len(starts) else len(b)
    return Found("audio/flac", at, end, at, end)


@of_blob
def _flac_starts(b: bytes) -> list[int]:
    """Marks with metadata blocks of right lengths, the first of them the stream's description, then a frame's mark.

    Blocks that several marks lead to are walked once.
    """
    ends_well: dict[int, bool] = {}

    def walk(p: int) -> bool:
        path = []
        while p not in ends_well:
            path.append(p)
            kind, size = (b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")) if p + 4 <= len(b) else (127, 0)
            after = p + 4 + size
            if kind in (0, 127) or after > len(b):
                ends_well[p] = False
            elif b[p] & 128:
                ends_well[p] = _frame(after)
            else:
                p = after
        for q in path:
            ends_well[q] = ends_well[p]
        return ends_well[p]

    def _frame(p: int) -> bool:
        return p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFE == 0xF8

    starts, at = [], b.find(b"fLaC")
    while at >= 0:
        p = at + 4
        if b[p + 1 : p + 4] == b"\0\0\x22" and b[p] & 127 == 0 and p + 38 <= len(b) and (_frame(p + 38) if b[p] & 128 else walk(p + 38)):
            starts.append(at)
        at = b.find(b"fLaC", at + 4)
    return starts


_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"meta", b"uuid", b"moof", b"mfra", b"sidx", b"styp", b"pdin"}


def _iso_media(b: bytes, at: int) -> Found | None:
    """Boxes by their lengths, from the file type on; one that describes the media must be among them."""
    p, described = at, False
    while p + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        head = 8
        if size == 1 and p + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        if name not in _BOXES or (name == b"ftyp") != (p == at) or (size and size < head) or p + size > len(b):
            break
        described |= name in (b"moov", b"meta", b"moof")
        p = p + size if size else len(b)
    return Found("video/mp4", at, p, at, p) if described else None


#: Signatures, the validators of their formats, and how far behind the format's start the signature stands.
FORMATS: dict[bytes, tuple[Callable[[bytes, int], Found | None], int]] = {
    b"RIFF": (_wav, 0),
    b"BM": (_bmp, 0),
    b".snd": (_au, 0),
    b"\x89PNG\r\n\x1a\n": (_png, 0),
    b"GIF87a": (_gif, 0),
    b"GIF89a": (_gif, 0),
    b"\xff\xd8\xff": (_jpeg, 0),
    b"%PDF-": (_pdf, 0),
    b"PK\x03\x04": (_zip, 0),
    b"OggS": (_ogg, 0),
    b"fLaC": (_flac, 0),
    b"ftyp": (_iso_media, 4),
}
WRITERS: tuple[tuple[str, Callable[[bytes], bytes]], ...] = (("audio/wav", to_wav), ("image/bmp", to_bmp), ("audio/basic", to_au))


@cache
def signatures() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, magic in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), (len(magic), i))
    a.make_automaton()
    return a


def sniff(blob: bytes) -> list[Found]:
    """Every confirmed format in the blob, by place."""
    checks = list(FORMATS.values())
    found = {}
    for end, (size, i) in signatures().iter(blob.decode("latin-1")):
        at = end + 1 - size
        check, back = checks[i]
        at -= back
        if at >= 0 and at not in found and (x := check(blob, at)):
            found[at] = x
    return [found[k] for k in sorted(found)]


def corrected(blob: bytes, declared: str | None) -> tuple[str, list[Found]]:
    """The confirmed type (else the declared one) and the embedded media behind the start."""
    found = sniff(blob)
    kind = found[0].kind if found and found[0].start == 0 else declared or "application/octet-stream"
    return kind, [x for x in found if x.start > 0]


# -- operator ------------------------------------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared (a type that may be wrong) and media: the text's bytes in a container."""

    def f(part: pa.RecordBatch) -> dict:
        texts = C.utf8_list(part.column("text"))
        media, declared = [], []
        for t in texts:
            x = padded(t)
            k = zlib.crc32(x)
            media.append(WRITERS[k % 3][1](x))
            declared.append(WRITERS[k // 3 % 3][0])
        return {"doc_id": part.column("doc_id"), "n_bytes": [len(t) for t in texts], "declared": declared, "media": media}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, n_bytes long, declared string, media binary", f)


CARVED = "array<struct<kind:string,start:long,end:long,bytes:binary>>"


def carve(df: DataFrame, column: str = "media", declared: str | None = "declared") -> DataFrame:
    """``df`` with ``type`` (the corrected one), ``payload`` (of the format at offset 0) and ``carved``: (kind, start, end, bytes) of each embedded media.

    ``column`` is any binary column, ``declared`` a column of types or None.
    """
    ship(df.sparkSession)
    schema = StructType([*df.schema, StructField("type", StringType()), StructField("payload", BinaryType()), StructField("carved", _parse_datatype_string(CARVED))])
    out, names = to_arrow_schema(schema), df.columns

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, column):
                said = part.column(declared).to_pylist() if declared else [None] * part.num_rows
                kinds, payloads, carved = [], [], []
                for blob, name in zip(part.column(column).to_pylist(), said):
                    kind, payload, inner = read(blob, name)
                    kinds.append(kind)
                    payloads.append(payload)
                    carved.append([{"kind": x.kind, "start": x.start, "end": x.end, "bytes": blob[x.start : x.end]} for x in inner])
                own = {n: part.column(n) for n in names}
                yield C.as_batch(own | {"type": kinds, "payload": payloads, "carved": carved}, out)

    return df.mapInArrow(run, schema)


def read(blob: bytes | None, declared: str | None) -> tuple[str | None, bytes | None, list[Found]]:
    """The corrected type, the payload of the format at offset 0 (else the blob), and the embedded media."""
    if blob is None:
        return None, None, []
    found = sniff(blob)
    if found and found[0].start == 0:
        return found[0].kind, blob[found[0].payload_start : found[0].payload_end], found[1:]
    return declared or "application/octet-stream", blob, found


def features(stored: DataFrame) -> DataFrame:
    """From stored media: the payload read back, its digests, and what carving says of the type and of embedded media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = C.arrow_schema(stored.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "media"):
                cols: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                for blob, declared, kind, x, inner in zip(*(part.column(c).to_pylist() for c in ("media", "declared", "type", "payload", "embedded"))):
                    row = (None,) * len(cols) if blob is None else (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(kind, declared, inner, x))
                    for k, v in zip(cols, row):
                        cols[k].append(v)
                yield C.as_batch(cols | {"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes")}, out)

    return carve(stored).withColumn("embedded", F.size("carved")).drop("carved").mapInArrow(run, schema)


def feature(kind: str, declared: str | None, embedded: int, payload: bytes) -> str:
    mean = float(np.frombuffer(payload, np.uint8).mean()) if payload else 0.0
    return f"{kind};{'as declared' if kind == declared else f'declared {declared}'};embedded={embedded};mean={mean:.4f}"


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(C.written(store(C.table(spark, sf_dir, "documents"))))
