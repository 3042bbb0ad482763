"""Legacy archive converter: ARC files to WARC files, and readers and writers of both.

ARC files (version 1 and 2) are parsed by the field names that their version block declares and by each record's declared length, never by
searching for separators. Conversion synthesises WARC record identifiers (UUIDs from a record's own fields), ISO dates, types and SHA-256
digests, and turns later captures of equal payloads into revisit records.

Archives are files of gzip members, one record each, in any folder that Spark can write. Spark's text writer lays the members down as they
are, an empty member (20 bytes that unpack to nothing) standing as its line separator; ``binaryFile`` reads them back file by file. A
line holds members of ``LINE_BYTES`` or one more, and a file ``PER_FILE`` lines, so files are bounded by bytes whatever the records' sizes.

Records that can't be parsed (a header line of the wrong number of fields, a length that is no number or beyond the member, a damaged
member) don't stop a conversion: they are left out of it, with what lies behind them in their member, and ``rejected`` lists them.

Defined results: null html is an empty payload; a null id is kept and never is what others refer to unless alone; of equal payloads of at
least ``LEAST`` bytes every row with the smallest id is a response, so repeated rows of it stay responses; equal payloads with null ids
only are all responses. White space and control characters of a url are percent-encoded; a null url is ``about:blank``. An empty table
gives no records. Pages of up to some 100 MB are stored whole. Only page_id, url and html are read, so other columns don't clash.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common as C

#: Smaller payloads are stored each.
LEAST = 100
#: Bytes of unpacked records in a line of an archive file, and its lines.
LINE_BYTES, PER_FILE = 2 << 20, 32
#: Groups of equal payloads whose first captures are broadcast (under 200 bytes each); beyond, they are joined by a shuffle.
MAX_BROADCAST = 100_000
LEVEL = 2
#: Captures of pages get this date, as pages have none.
CAPTURED = "20240101000000"
EMPTY = gzip.compress(b"", mtime=0)
V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")


# -- gzip members --------------------------------------------------------------------------------------------------------------


def member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def members(blob: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of a file's members that aren't empty."""
    view, at = memoryview(blob), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            part = view[at : at + step]
            out.append(d.decompress(part))
            at += len(part)
        at -= len(d.unused_data)
        if data := b"".join(out):
            yield data


def write_members(df: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """The binary column ``value`` as files of ``per_file`` lines."""
    lines = df.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# -- ARC -----------------------------------------------------------------------------------------------------------------------


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    offset: int
    block: bytes


def clean_url(url: str | None) -> str:
    if not url:
        return "about:blank"
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def version_block(version: int, name: str) -> bytes:
    fields = " ".join(V1 if version == 1 else V2)
    body = f"{version} 0 courtflux\n{fields}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, block: bytes, name: str, offset: int) -> bytes:
    extra = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{url} 0.0.0.0 {CAPTURED} text/html {extra}{len(block)}\n".encode() + block + b"\n"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


class Lines:
    """Members gathered into lines of bounded bytes; each file begins with ``head(number of the file)``."""

    def __init__(self, head: Callable[[int], bytes], limits: tuple[int, int]):
        self.head, self.done, self.held, self.size, self.offset = head, 0, [], 0, 0
        self.line_bytes, self.per_file = limits

    @property
    def file(self) -> int:
        return self.done // self.per_file

    def begin(self) -> None:
        if not self.held and self.done % self.per_file == 0:
            self.offset = 0
            self._put(self.head(self.file))

    def _put(self, data: bytes) -> None:
        own = member(data)
        self.held.append(own)
        self.size += len(data)
        self.offset += len(own)

    def add(self, data: bytes) -> bytes | None:
        """A finished line, if this record fills it. ``begin`` goes before each record."""
        self._put(data)
        return self.close() if self.size >= self.line_bytes else None

    def close(self) -> bytes | None:
        if not self.held:
            return None
        line = b"".join(self.held)
        self.held, self.size, self.done, self.offset = [], 0, self.done + 1, self.offset + len(EMPTY)
        return line


def lines_of(records: Iterator[bytes], lines: Lines) -> Iterator[pa.RecordBatch]:
    def batch(line: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["value"])

    for data in records:
        if line := lines.add(data):
            yield batch(line)
    if line := lines.close():
        yield batch(line)


def _declared(length: str) -> int:
    """A declared length: plain digits alone, so that a reader always moves on."""
    if not (length.isascii() and length.isdigit()):
        raise ValueError(f"{length[:20]!r} is no length")
    return int(length)


def parse_arc(data: bytes, fields: tuple[str, ...] | None = None) -> Iterator[tuple[tuple[str, ...], ArcRecord | None]]:
    """Records of unpacked ARC bytes, each with the field names in force; a version block sets them and gives no record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        eol = data.index(b"\n", at)
        parts = data[at:eol].decode("utf-8", "replace").strip("\r").split(" ")
        start = eol + 1
        if parts[0].startswith("filedesc:"):
            size = _declared(parts[-1])
            if start + size > len(data):
                raise ValueError("a version block is cut short")
            lines = data[start : start + size].decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            fields = tuple(lines[1].strip().split(" ")) if len(lines) > 1 and lines[1].strip() else (V2 if version == "2" else V1)
            yield fields, None
        else:
            if fields is None:
                raise ValueError("an ARC record stands before the version block")
            if len(parts) != len(fields):
                raise ValueError(f"{len(parts)} fields in a header line of {len(fields)}")
            named = dict(zip(fields, parts))
            size = _declared(named["Archive-length"])
            if start + size > len(data):
                raise ValueError("an ARC record is cut short")
            yield fields, ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], at, data[start : start + size])
        at = start + size


def write_arc(pages: DataFrame, path: str, limits: tuple[int, int] = (LINE_BYTES, PER_FILE)) -> None:
    """Each page as a record of a legacy archive; files of tasks with even numbers are of version 1, others of version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2
        lines = Lines(lambda k: version_block(version, f"{task}-{k}.arc.gz"), limits)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for part in C.slices(batch, "html"):
                    for page_id, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), C.utf8_list(part.column("html"))):
                        lines.begin()
                        yield arc_record(version, clean_url(url), http_response(page_id, html), f"{task}-{lines.file}.arc.gz", lines.offset)

        yield from lines_of(records(), lines)

    ship(pages.sparkSession)
    write_members(pages.select("page_id", "url", "html").mapInArrow(run, "value binary"), path, limits[1])


# -- WARC ----------------------------------------------------------------------------------------------------------------------


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    seed = hashlib.sha256(f"{url}\n{date}\n{page_id}\n{digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=4)}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of unpacked WARC bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one must begin")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError("a WARC record's length is wrong")
        yield fields, block
        at = stop + 8 + size


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header bytes, headers and payload of an HTTP response; without a header, all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        return b"", {}, block
    return block[: stop + 4], dict(x.split(": ", 1) for x in block[:stop].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x), block[stop + 4 :]


def _page_id(headers: dict[str, str]) -> int | None:
    own = headers.get("X-Page-Id", "")
    return int(own) if own.removeprefix("-").isdecimal() else None


def arc_records(blob: bytes) -> Iterator[tuple[int, ArcRecord | None, str | None]]:
    """A file's records as (member, record, None), and what can't be parsed as (member, None, reason)."""
    fields, at = None, -1
    try:
        for at, data in enumerate(members(blob)):
            try:
                for fields, rec in parse_arc(data, fields):
                    if rec is not None:
                        yield at, rec, None
            except (ValueError, KeyError, IndexError) as e:
                yield at, None, f"{type(e).__name__}: {e}"
    except (ValueError, zlib.error) as e:  # what lies behind a damaged member can't be found
        yield at + 1, None, f"{type(e).__name__}: {e}"


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """path, member and reason of what the ARC files hold that can't be parsed."""
    ship(spark)
    schema = "path string, member long, reason string"
    out = C.arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [(name, at, reason) for at, _, reason in arc_records(blob.as_py()) if reason]
                if rows:
                    yield C.as_batch(dict(zip(out.names, map(list, zip(*rows)))), out)

    return read_files(spark, path).mapInArrow(run, schema)


def arc_captures(spark: SparkSession, path: str, blocks: bool) -> DataFrame:
    """The ARC files' records: page_id, url, date, digest and size of the payload, and with ``blocks`` the ip, type and whole block."""
    ship(spark)
    schema = "page_id long, url string, date string, digest binary, size long" + (", ip string, mime string, block binary" if blocks else "")
    out = C.arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return C.as_batch(dict(zip(out.names, map(list, zip(*rows)))), out)

        for batch in batches:
            for blob in batch.column("content"):
                for _, rec, _ in arc_records(blob.as_py()):
                    if rec is None:
                        continue
                    _, headers, payload = split_http(rec.block)
                    row = (_page_id(headers), rec.url, rec.date, hashlib.sha256(payload).digest(), len(payload))
                    rows.append(row + (rec.ip, rec.mime, rec.block) if blocks else row)
                    held += len(rec.block) if blocks else 100
                    if held > C.SLICE_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return read_files(spark, path).mapInArrow(run, schema)


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST, max_broadcast: int = MAX_BROADCAST, limits: tuple[int, int] = (LINE_BYTES, PER_FILE)) -> None:
    """Writes the ARC files' records as WARC files."""
    light = arc_captures(spark, arc, blocks=False).where(F.col("size") >= least)
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "date")
    repeated = C.written(light.groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first")).where("n > 1 and not first.none").select("digest", "first.page_id", "first.url", "first.date").toDF("digest", "to_page", "to_url", "to_date"))
    few = repeated.count() <= max_broadcast

    def warcinfo(task: int, k: int) -> bytes:
        info = b"software: courtflux\r\nformat: WARC File Format 1.1\r\n"
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"{task}-{k}", CAPTURED, None, "info")), ("WARC-Date", iso(CAPTURED)), ("Content-Type", "application/warc-fields")], info)

    def converted(r: dict) -> bytes:
        digest = r["digest"].hex()
        revisit = r["to_page"] is not None and r["to_page"] != r["page_id"]
        head, _, _ = split_http(r["block"])
        fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(r["url"], r["date"], r["page_id"], digest)), ("WARC-Date", iso(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response" if head else r["mime"])]
        if revisit:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["to_url"], r["to_date"], r["to_page"], digest)), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", iso(r["to_date"])), ("X-Refers-To-Page", str(r["to_page"]))]
        return warc_record(fields, head if revisit else r["block"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in C.slices(batch, "block"):
                yield from part.to_pylist()

    def run(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        lines = Lines(lambda k: warcinfo(task, k), limits)

        def records() -> Iterator[bytes]:
            for r in rows(batches):
                lines.begin()
                yield converted(r)

        yield from lines_of(records(), lines)

    if few:  # records go from file to file, their repeats looked up
        known = C.broadcast_value(spark, {bytes(r.digest): (r.to_page, r.to_url, r.to_date) for r in repeated.collect()})

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for blob in batch.column("content"):
                    for _, rec, _ in arc_records(blob.as_py()):
                        if rec is not None:
                            _, headers, payload = split_http(rec.block)
                            digest = hashlib.sha256(payload).digest()
                            to = known.value.get(digest, (None, None, None))
                            yield {"page_id": _page_id(headers), "url": rec.url, "date": rec.date, "digest": digest, "ip": rec.ip, "mime": rec.mime, "block": rec.block, "to_page": to[0], "to_url": to[1], "to_date": to[2]}

        made = read_files(spark, arc).mapInArrow(lambda batches: run(looked_up, batches), "value binary")
    else:  # a join; a digest that many records share is one key, whose rows adaptive execution splits
        made = arc_captures(spark, arc, blocks=True).join(repeated, "digest", "left").mapInArrow(lambda batches: run(joined, batches), "value binary")
    write_members(made, warc, limits[1])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files; a response's digests are computed from what was read and must be as declared."""
    ship(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string"
    out = C.arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("content"):
                rows = []
                for data in members(blob.as_py()):
                    for fields, block in parse_warc(data):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        _, headers, payload = split_http(block)
                        declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != declared:
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
                        size = len(payload) if kind == "response" else int(headers["Content-Length"])
                        to = fields.get("X-Refers-To-Page")
                        rows.append((_page_id(headers), size, declared, kind, None if to is None else int(to), fields["WARC-Record-ID"], fields["WARC-Date"], fields["WARC-Target-URI"]))
                if rows:
                    yield C.as_batch(dict(zip(out.names, map(list, zip(*rows)))), out)

    return read_files(spark, path).mapInArrow(run, schema)


def archive(pages: DataFrame, **how: int) -> DataFrame:
    """Pages through legacy archives and the converter, as read back from the WARC files."""
    spark = pages.sparkSession
    arc, warc = C.shared_dir(spark), C.shared_dir(spark)
    write_arc(pages, arc)
    convert(spark, arc, warc, **how)
    C.drop_dir(spark, arc)
    return read_warc(spark, warc)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(C.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
