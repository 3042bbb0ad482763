"""Environments are bounded by bytes: a larger table gives more of them."""

import os

from courtflux.sources import lmdb


def test_more_environments_for_more_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(b"label-%09d" % k, b"x" * (k % 300)) for k in range(1000)], "key binary, value binary")
    for most, parts in ((1 << 30, 2), (20_000, 8)):
        folder = str(tmp_path / str(most))
        lmdb.write_lmdb(rows, folder, 2, file_bytes=most)
        assert len([p for p in os.listdir(folder) if p.startswith("part-")]) == parts
        assert {(bytes(r.key), bytes(r.value)) for r in lmdb.read_lmdb(spark, folder).collect()} == {(bytes(r.key), bytes(r.value)) for r in rows.collect()}
