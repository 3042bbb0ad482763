"""LMDB files as a Spark data source: B+ tree pages read without the library, partitions of neighbouring subtrees; bulk-loaded files, one a task.

``spark.read.format("lmdb_pages").load(path)`` gives key and value (binary) of an environment (a folder with data.mdb), or of all environments in
the folders of a folder. The driver reads the pages at the top, as many as there are
partitions (``partitionBytes`` of a file each); a task reads those of its subtrees, a page at a time. The option
``prefix`` (text) skips subtrees whose keys can't begin with it. ``df.write.format("lmdb_pages").mode("append").save(path)`` writes rows
(key, value) as one environment a partition: sort partitions by key first (``sorted_for_lmdb``). Files appear when all tasks have ended well;
a failed job leaves none. Paths are those of a file system that the driver and the executors have mounted.

Defined results: an empty environment gives no rows; of one key's rows in a partition the last counts; null keys or values, and keys of over
511 bytes, are errors, as LMDB has none. Databases within the main one and sorted duplicates are refused.
"""

from __future__ import annotations

import os
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..runtime import register_source

#: Fixed values of the format: page size, header sizes, flags, marks.
PAGE, HEAD, NODE = 4096, 16, 8
BRANCH, LEAF, OVERFLOW, META = 1, 2, 4, 8
BIG, SUB, DUP = 1, 2, 4
MAGIC, VERSION, NO_PAGE, LONGEST_KEY = 0xBEEFC0DE, 1, (1 << 64) - 1, 511
#: Largest node that stays in its page, as two must fit.
NODE_MOST = ((PAGE - HEAD) // 2 & ~1) - 2
#: Bytes of a file for each partition.
PARTITION_BYTES = 64 << 20
#: Bytes of keys and values for each environment that is written.
FILE_BYTES = 64 << 20


class Pages:
    """An open file's pages; the newer of its two meta pages counts."""

    def __init__(self, f: BinaryIO):
        self.f, self.size = f, PAGE
        metas = []
        for at in (0, self._page_size()):
            f.seek(at)
            m = f.read(HEAD + 8 + 16 + 96 + 16)
            if len(m) == HEAD + 136 and struct.unpack_from("<II", m, HEAD) == (MAGIC, VERSION):
                metas.append((struct.unpack_from("<Q", m, HEAD + 128)[0], m))
        if not metas:
            raise ValueError("no LMDB file of version 1")
        main = max(metas)[1][HEAD + 24 + 48 :]
        _, flags, _, _, _, _, self.entries, self.root = struct.unpack_from("<IHHQQQQQ", main)
        if flags:
            raise ValueError(f"a database with flags {flags:#x}")

    def _page_size(self) -> int:
        self.f.seek(HEAD + 24)
        (size,) = struct.unpack("<I", self.f.read(4))  # the free list's pad
        self.size = size or PAGE
        return self.size

    def read(self, number: int, pages: int = 1) -> bytes:
        self.f.seek(number * self.size)
        return self.f.read(pages * self.size)

    def nodes(self, page: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """(low, high, flags, key size, place of the key) of a page's nodes."""
        lower = struct.unpack_from("<H", page, 12)[0]
        for (at,) in struct.iter_unpack("<H", page[HEAD:lower]):
            yield *struct.unpack_from("<HHHH", page, at), at + NODE

    def children(self, page: bytes) -> list[tuple[bytes, int]]:
        """(first key, page) of a branch's subtrees; the first one's key is empty."""
        return [(page[k : k + size], low | high << 16 | flags << 32) for low, high, flags, size, k in self.nodes(page)]

    def rows(self, number: int, prefix: bytes) -> Iterator[tuple[bytes, bytes]]:
        """The rows of a subtree in order of keys."""
        page = self.read(number)
        if struct.unpack_from("<H", page, 10)[0] & BRANCH:
            for _, child in within(self.children(page), prefix):
                yield from self.rows(child, prefix)  # as deep as the tree, a handful of levels
            return
        for low, high, flags, size, k in self.nodes(page):
            key, length, at = page[k : k + size], low | high << 16, k + size
            if not key.startswith(prefix):
                continue
            if flags & (SUB | DUP):
                raise ValueError("a key with a database or duplicates of its own")
            if flags & BIG:
                over = struct.unpack_from("<Q", page, at)[0]
                yield key, self.read(over, -(-(HEAD + length) // self.size))[HEAD : HEAD + length]
            else:
                yield key, page[at : at + length]


def within(children: list[tuple[bytes, int]], prefix: bytes) -> list[tuple[bytes, int]]:
    """Those that may hold keys with the prefix: the next one doesn't begin at or before it, and they don't begin behind it."""
    ends = [k for k, _ in children[1:]] + [None]
    return [(k, p) for (k, p), end in zip(children, ends) if (end is None or end > prefix) and (k <= prefix or k.startswith(prefix))]


@dataclass
class Subtrees(InputPartition):
    """Neighbouring subtrees of a file."""

    path: str
    roots: list[int]


class _Reader(DataSourceReader):
    def __init__(self, path: str, prefix: str, size: int):
        self.path, self.prefix, self.size = path, prefix.encode(), size

    def partitions(self) -> list[Subtrees]:
        """Of each file as many runs of subtrees as its bytes ask for, from the first level of its tree that has enough."""
        own = os.path.join(self.path, "data.mdb")
        files = [own] if os.path.exists(own) else sorted(p for e in os.scandir(self.path) if e.is_dir() and os.path.exists(p := os.path.join(e.path, "data.mdb")))
        out = []
        for path in files:
            with open(path, "rb") as f:
                pages, want = Pages(f), -(-os.path.getsize(path) // self.size)
                level = [pages.root] if pages.root != NO_PAGE else []
                while level and len(level) < want and struct.unpack_from("<H", pages.read(level[0]), 10)[0] & BRANCH:
                    level = [child for n in level for _, child in within(pages.children(pages.read(n)), self.prefix)]
                cuts = [len(level) * k // want for k in range(want + 1)]
                out += [Subtrees(path, level[a:z]) for a, z in zip(cuts, cuts[1:]) if a < z]
        return out or [Subtrees("", [])]

    def read(self, partition: Subtrees) -> Iterator[tuple[bytes, bytes]]:
        if partition.roots:
            with open(partition.path, "rb") as f:
                pages = Pages(f)
                for root in partition.roots:
                    yield from pages.rows(root, self.prefix)


class Loader:
    """Writes sorted rows as a file: leaves as they fill, then branches level by level, then the meta pages."""

    def __init__(self, f: BinaryIO):
        self.f, self.next, self.entries = f, 2, 0
        self.counts = {BRANCH: 0, LEAF: 0, OVERFLOW: 0}
        f.write(bytes(2 * PAGE))
        self.leaves: list[tuple[bytes, int]] = []
        self.nodes: list[tuple[bytes, bytes]] = []
        self.room = PAGE - HEAD

    def _page(self, flags: int, nodes: list[bytes]) -> int:
        at, ends, upper = self.next, [], PAGE
        for n in nodes:
            upper -= len(n)
            ends.append(upper)
        head = struct.pack("<QHHHH", at, 0, flags, HEAD + 2 * len(nodes), upper)
        body = head + struct.pack(f"<{len(nodes)}H", *ends)
        self.f.write(body + bytes(upper - len(body)) + b"".join(reversed(nodes)))
        self.next += 1
        self.counts[flags] += 1
        return at

    def _leaf(self) -> None:
        if self.nodes:
            self.leaves.append((self.nodes[0][0], self._page(LEAF, [n for _, n in self.nodes])))
            self.nodes, self.room = [], PAGE - HEAD

    def add(self, key: bytes, value: bytes) -> None:
        if not 0 < len(key) <= LONGEST_KEY:
            raise ValueError(f"a key of {len(key)} bytes")
        flags, data = 0, value
        if NODE + len(key) + len(value) > NODE_MOST:
            pages = -(-(HEAD + len(value)) // PAGE)
            self.f.write(struct.pack("<QHHI", self.next, 0, OVERFLOW, pages) + value + bytes(pages * PAGE - HEAD - len(value)))
            flags, data = BIG, struct.pack("<Q", self.next)
            self.next += pages
            self.counts[OVERFLOW] += pages
        node = struct.pack("<HHHH", len(value) & 0xFFFF, len(value) >> 16, flags, len(key)) + key + data
        node += bytes(len(node) & 1)
        if len(node) + 2 > self.room:
            self._leaf()
        self.nodes.append((key, node))
        self.room -= len(node) + 2
        self.entries += 1

    def close(self) -> None:
        self._leaf()
        level, depth = self.leaves, int(bool(self.leaves))
        while len(level) > 1:
            up, nodes, first, room = [], [], b"", PAGE - HEAD
            for key, page in level:
                own = b"" if not nodes else key  # the first key of a branch is not compared
                node = struct.pack("<HHHH", page & 0xFFFF, page >> 16 & 0xFFFF, page >> 32, len(own)) + own
                node += bytes(len(node) & 1)
                if nodes and len(node) + 2 > room:
                    up.append((first, self._page(BRANCH, nodes)))
                    nodes, room = [], PAGE - HEAD
                    node = struct.pack("<HHHH", page & 0xFFFF, page >> 16 & 0xFFFF, page >> 32, 0)
                if not nodes:
                    first = key
                nodes.append(node)
                room -= len(node) + 2
            up.append((first, self._page(BRANCH, nodes)))
            level, depth = up, depth + 1
        root = level[0][1] if level else NO_PAGE
        empty = struct.pack("<IHHQQQQQ", PAGE, 0, 0, 0, 0, 0, 0, NO_PAGE)
        main = struct.pack("<IHHQQQQQ", 0, 0, depth, self.counts[BRANCH], self.counts[LEAF], self.counts[OVERFLOW], self.entries, root)
        self.f.seek(0)
        for n in (0, 1):
            meta = struct.pack("<QHHI", n, 0, META, 0) + struct.pack("<IIQQ", MAGIC, VERSION, 0, max(self.next * PAGE, 1 << 20)) + empty + main + struct.pack("<QQ", self.next - 1, n)
            self.f.write(meta + bytes(PAGE - len(meta)))


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = os.path.join(path, f".writing-{uuid.uuid4().hex}")
        os.makedirs(self.job)

    def write(self, iterator: Iterator) -> Written:
        folder = os.path.join(self.job, uuid.uuid4().hex)  # an attempt's own
        os.mkdir(folder)  # fails once the job was given up
        rows, last = 0, None
        with open(os.path.join(folder, "data.mdb"), "wb") as f:
            out = Loader(f)
            for row in iterator:
                key, value = bytes(row[0]), bytes(row[1])
                if last is not None and key < last[0]:
                    raise ValueError("rows of a partition must be sorted by key")
                if last is not None and key != last[0]:
                    out.add(*last)
                last, rows = (key, value), rows + 1
            if last is not None:
                out.add(*last)
            out.close()
        return Written(folder if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        gone = [e.path for e in os.scandir(self.path) if e.name.startswith("part-")] if self.overwrite else []
        for k, m in enumerate(messages):
            if m is not None and m.folder:
                os.replace(m.folder, os.path.join(self.path, f"part-{os.path.basename(self.job)[9:17]}-{k:05d}"))
        for p in gone:
            shutil.rmtree(p)
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        for _ in range(20):  # tasks that are being stopped may still write
            shutil.rmtree(self.job, ignore_errors=True)
            if not os.path.exists(self.job):
                break
            time.sleep(0.1)


class LmdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lmdb_pages"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("prefix", ""), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def sorted_for_lmdb(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows (key, value) by ranges of keys, sorted, so that each environment holds a range."""
    return rows.repartitionByRange(partitions, "key").sortWithinPartitions("key").select("key", "value")


def read_lmdb(spark: SparkSession, path: str, prefix: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    register_source(spark, LmdbSource)
    return spark.read.format("lmdb_pages").option("prefix", prefix).option("partitionBytes", partition_bytes).load(path)


def write_lmdb(rows: DataFrame, path: str, partitions: int = 8, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    """Rows (key, value) as ``partitions`` environments, more where these would have over ``file_bytes`` each: a task's work doesn't grow with the table."""
    size = rows.agg(F.sum(F.length("key") + F.length("value"))).first()[0] or 0
    partitions = max(partitions, -(-size // file_bytes))
    register_source(rows.sparkSession, LmdbSource)
    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    sorted_for_lmdb(rows, partitions).write.format("lmdb_pages").mode(mode).save(path.removeprefix("file://"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """index and label of a labelled corpus: keys label-%09d, counted from 1."""
    rows = read_lmdb(spark, path, "label-")
    return rows.select(F.substring(F.col("key").cast("string"), 7, 20).cast("long").alias("index"), F.col("value").cast("string").alias("label"))
