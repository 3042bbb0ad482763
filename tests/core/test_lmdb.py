"""LMDB files: round trips of small and large trees, by several environments, prefixes, faults, and jobs that fail."""

import io
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from courtflux.sources import lmdb


def loaded(rows):
    f = io.BytesIO()
    out = lmdb.Loader(f)
    for k, v in rows:
        out.add(k, v)
    out.close()
    return f


@pytest.mark.parametrize("n, most", [(0, 10), (1, 10), (3, 5000), (500, 60), (4000, 300), (60, 9000)])
def test_pages_round_trip(n, most):
    rng = random.Random(n)
    rows = sorted({bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randint(1, 200))): rng.randbytes(rng.randint(0, most)) for _ in range(n)}.items())
    f = loaded(rows)
    pages = lmdb.Pages(f)
    assert pages.entries == len(rows)
    assert (list(pages.rows(pages.root, b"")) if rows else []) == rows
    for prefix in (b"a", b"ab", b"\xff", b"abcabc", b"zz"):
        assert (list(pages.rows(pages.root, prefix)) if rows else []) == [r for r in rows if r[0].startswith(prefix)]


def test_the_format_literally():
    """Marks, places and sizes as the format has them."""
    f = loaded([(b"k1", b"v1"), (b"k2", b"x" * 5000)])
    data = f.getvalue()
    assert len(data) == (2 + 2 + 1) * 4096  # two meta pages, an overflow of two, a leaf
    for n in (0, 1):
        page = data[n * 4096 :]
        assert struct.unpack_from("<QHH", page) == (n, 0, 8) and struct.unpack_from("<II", page, 16) == (0xBEEFC0DE, 1)
        assert struct.unpack_from("<I", page, 40)[0] == 4096 and struct.unpack_from("<Q", page, 80)[0] == 2**64 - 1  # the free list is empty
        pad, flags, depth, branches, leaves, over, entries, root = struct.unpack_from("<IHHQQQQQ", page, 88)
        assert (flags, depth, branches, leaves, over, entries, root) == (0, 1, 0, 1, 2, 2, 4)
        assert struct.unpack_from("<QQ", page, 136) == (4, n)
    leaf = data[4 * 4096 :]
    assert struct.unpack_from("<QHHHH", leaf)[2:4] == (2, 20)
    a, b = struct.unpack_from("<HH", leaf, 16)
    assert leaf[a : a + 12] == struct.pack("<HHHH", 2, 0, 0, 2) + b"k1v1"
    assert leaf[b : b + 18] == struct.pack("<HHHH", 5000, 0, 1, 2) + b"k2" + struct.pack("<Q", 2)
    assert struct.unpack_from("<QHHI", data, 2 * 4096) == (2, 0, 4, 2)


def test_the_newer_meta_page_counts():
    data = bytearray(loaded([(b"a", b"1")]).getvalue())
    struct.pack_into("<Q", data, 16 + 128, 9)  # page 0 is the newer one now
    struct.pack_into("<Q", data, 88 + 40, 2**64 - 1)  # and it is empty
    assert lmdb.Pages(io.BytesIO(data)).root == 2**64 - 1
    with pytest.raises(ValueError, match="no LMDB"):
        lmdb.Pages(io.BytesIO(bytes(9000)))


def test_source_and_sink(spark, tmp_path):
    path = str(tmp_path / "db")
    rows = spark.range(1, 20_001).select(F.format_string("label-%09d", "id").cast("binary").alias("key"), F.expr("cast(concat('t', id, repeat('x', cast(id % 3000 as int))) as binary)").alias("value"))
    lmdb.write_lmdb(rows.unionAll(spark.sql("select cast('num-samples' as binary) as key, cast('20000' as binary) as value")).repartition(7), path, 3)
    assert len([n for n in os.listdir(path) if n.startswith("part-")]) == 3 and not [n for n in os.listdir(path) if n.startswith(".")]
    got = lmdb.labels(spark, path)
    assert got.count() == 20_000 and got.where("label <> concat('t', index, repeat('x', cast(index % 3000 as int)))").count() == 0
    parts = lmdb.read_lmdb(spark, path, partition_bytes=3 << 20)
    assert 8 < parts.rdd.getNumPartitions() < 20 and parts.count() == 20_001  # runs of subtrees, not files
    assert [bytes(r.value) for r in lmdb.read_lmdb(spark, path, "num-").collect()] == [b"20000"]
    lmdb.write_lmdb(spark.sql("select cast('z' as binary) as key, cast('1' as binary) as value"), path, 1)
    assert lmdb.read_lmdb(spark, path).count() == 20_002
    lmdb.write_lmdb(spark.sql("select cast('z' as binary) as key, cast('1' as binary) as value"), path, 1, "overwrite")
    assert [(bytes(r.key), bytes(r.value)) for r in lmdb.read_lmdb(spark, path).collect()] == [(b"z", b"1")]


@pytest.mark.parametrize("bad", ["cast(null as binary)", "cast(repeat('k', 600) as binary)", "cast('' as binary)"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "db")
    rows = spark.range(2000).select(F.format_string("%05d", "id").cast("binary").alias("key"), F.lit(b"v").alias("value")).unionAll(spark.sql(f"select {bad} as key, cast('1' as binary) as value"))
    with pytest.raises(Exception):
        lmdb.write_lmdb(rows, path, 4)
    assert not [n for n in os.listdir(path) if n.startswith("part-")]
    assert lmdb.read_lmdb(spark, path).count() == 0
